"""The catalogue's functions with parameters, callable from SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (parameters, returned columns, body). A body names the views that the caller registers.
FUNCTIONS = {
    "get_top_searches": (
        "n INT DEFAULT 10, kind STRING DEFAULT 'search'",
        "query STRING, count BIGINT",
        """SELECT query, count FROM (SELECT query, count, row_number() OVER (ORDER BY count DESC, query) AS place
           FROM (SELECT lower(trim(query)) AS query, count(*) AS count FROM search_queries WHERE source = kind AND trim(query) <> '' GROUP BY 1))
           WHERE place <= n""",
    ),
    "subscribe_email": (
        "address STRING",
        "email STRING",
        r"""SELECT a.email FROM (SELECT lower(trim(address)) AS email) a LEFT ANTI JOIN subscribers s ON a.email = s.email
            WHERE length(a.email) BETWEEN 6 AND 254 AND a.email RLIKE '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$'""",
    ),
    "unsubscribe_by_token": ("given STRING", "id BIGINT", "SELECT id FROM subscribers WHERE token = given AND active"),
}


def register_functions(spark: SparkSession, **views: DataFrame) -> None:
    """Register FUNCTIONS over temporary views of the given tables: search_queries; subscribers (id, email, token, active).

    get_top_searches(n, kind) ranks queries; subscribe_email(address) gives the address to
    insert, or no row; unsubscribe_by_token(given) gives the subscriber to switch off.
    """
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    for name, (parameters, columns, body) in FUNCTIONS.items():
        if all(view in views for view in ("search_queries", "subscribers") if view in body):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
