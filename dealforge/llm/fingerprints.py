"""Operator 2: document fingerprints from prefix polynomial hashes.

H[i] is the sum of c[j] * B^j over j < i, modulo a prime; two primes give 62 bits.
With these arrays the hash of any span takes one subtraction and one product, so all
windows of a text are hashed at once, spans are compared in constant time, and the
longest common extension of two places is found by binary search. A fingerprint keeps
the least window hashes of a text, from which likeness is estimated; its standard
error is at most half of one over the root of their number.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealforge.llm.common import arrow_schema, read_table, scratch

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)
#: Code points a window, and window hashes that a fingerprint keeps.
WINDOW = 16
KEPT = 32

_powers: list = [[None, None], [None, None]]


def powers(k: int, inverse: bool, n: int):
    """B^0 .. B^(n-1) (or of B's inverse) modulo the k-th prime."""
    import numpy as np

    p = PRIMES[k]
    base = pow(BASES[k], -1, p) if inverse else BASES[k]
    table = _powers[k][inverse]
    if table is None:
        table = np.ones(1, dtype=np.uint64)
    while len(table) < n:
        table = np.concatenate([table, table * np.uint64(pow(base, len(table), p)) % np.uint64(p)])
    _powers[k][inverse] = table
    return table[:n]


class Prefixes:
    """The prefix arrays of a text."""

    def __init__(self, text: str):
        import numpy as np

        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        self.n, self.sums = len(codes), []
        for k, p in enumerate(PRIMES):
            terms = codes * powers(k, False, self.n) % np.uint64(p)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms) % np.uint64(p)]))

    def spans(self, starts, length: int):
        """Hashes of the spans of one length at some starts, moved to position 0."""
        import numpy as np

        out = []
        for k, p in enumerate(PRIMES):
            h, p = self.sums[k], np.uint64(p)
            out.append((h[starts + length] + p - h[starts]) % p * powers(k, True, self.n + 1)[starts] % p)
        return out[0] << np.uint64(31) | out[1]

    def span(self, start: int, length: int) -> int:
        import numpy as np

        return int(self.spans(np.array([start]), length)[0])

    def whole(self) -> int:
        return int(self.sums[0][-1]) << 31 | int(self.sums[1][-1])


def same(a: Prefixes, i: int, b: Prefixes, j: int, length: int) -> bool:
    """Whether two spans are equal (up to a collision of 62 bits)."""
    return a.span(i, length) == b.span(j, length)


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """How many code points from a[i:] and b[j:] on are equal."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if same(a, i, b, j, mid) else (low, mid - 1)
    return low


def fingerprint(prefixes: Prefixes, window: int = WINDOW, kept: int = KEPT) -> str:
    """Length and hash of the whole text, then the least of its mixed window hashes.

    A text of fewer code points than a window is one window; an empty one has none.
    """
    import numpy as np

    n = prefixes.n
    head = f"{n:x}.{prefixes.whole():016x}."
    if not n:
        return head
    width = min(n, window)
    h = prefixes.spans(np.arange(n - width + 1), width)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0x94D049BB133111EB) >> np.uint64(24)
    h = np.unique(h)[:kept] if len(h) <= 4 * kept else least(h, kept)
    return head + "".join(f"{x:010x}" for x in h.tolist())


def least(h, kept: int):
    """The least distinct values; repeated ones can push others out of a first guess."""
    import numpy as np

    n = 4 * kept
    while True:
        out = np.unique(np.partition(h, n)[:n]) if n < len(h) else np.unique(h)
        if len(out) >= kept or n >= len(h):
            return out[:kept]
        n *= 4


def likeness(a: str, b: str, kept: int = KEPT) -> float:
    """The estimated share of common windows: 1 for equal fingerprints."""
    if a == b:
        return 1.0
    sets = [{x[i : i + 10] for i in range(0, len(x), 10)} for x in (a.rpartition(".")[2], b.rpartition(".")[2])]
    least_of_both = sorted(sets[0] | sets[1])[:kept]
    return sum(x in sets[0] and x in sets[1] for x in least_of_both) / len(least_of_both) if least_of_both else 0.0


def edited_text(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: A row of the pass: of a finished document, of one that waits for the next part's first, or of a part's first.
DONE, WAITS, FIRST = 0, 1, 2
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
PASSED = SCHEMA + ", state int, part int, text string"


def finished(doc_id, text, prefixes, print_, following, print_next) -> dict:
    """A document's row of the result, beside the next document's text and fingerprint."""
    edited = edited_text(text, following)
    after = Prefixes(edited)
    print_edited = fingerprint(after)
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": print_,
        "edited_fingerprint": print_edited, "near_edited": likeness(print_, print_edited), "near_next": likeness(print_, print_next), "common_prefix": common_extension(prefixes, 0, after, 0),
    }


def batches_of(rows, arrow, size: int = 256):
    import pyarrow as pa

    out = []
    for row in rows:
        out.append(row)
        if len(out) >= size:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=arrow)


def in_order(docs: DataFrame) -> DataFrame:
    """One pass over ranges of descending doc_id: finished rows, and what the ends of parts leave open.

    Each part gives its last document, which waits, and its first one, which the last
    of the part before waits for; all others meet their next document in the pass.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.desc_nulls_last("doc_id"), F.desc("tie"), F.asc("row")]  # the row number deals out equal rows
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))

    arrow = arrow_schema(PASSED)

    def run(batches):
        def rows():
            held = None
            for batch in batches:
                for doc_id, text, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part"))):
                    prefixes = Prefixes(text)
                    print_ = fingerprint(prefixes)
                    if held is None:
                        yield {"doc_id": doc_id, "fingerprint": print_, "state": FIRST, "part": part, "text": text}
                    else:
                        yield finished(*held[:4], text, print_) | {"state": DONE, "part": part}
                    held = doc_id, text, prefixes, print_, part
            if held is not None:
                yield {"doc_id": held[0], "fingerprint": held[3], "state": WAITS, "part": held[4], "text": held[1]}

        yield from batches_of(rows(), arrow)

    return dealt.mapInArrow(run, PASSED)


def joined_ends(passed: DataFrame) -> DataFrame:
    """The rows of the documents that wait, each beside the first of the next part with rows; the last meets the very first.

    A table of one number a part finds the next part; texts meet by these numbers.
    """
    firsts = passed.filter(F.col("state") == FIRST).select("part", F.col("text").alias("following"), F.col("fingerprint").alias("print_next"))
    parts = firsts.select("part")
    upward = Window.orderBy("part")
    to = parts.select("part", F.coalesce(F.lead("part").over(upward), F.first("part").over(upward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))
    waits = passed.filter(F.col("state") == WAITS).select("doc_id", "text", "part").join(to, "part").select("doc_id", "text", "to")
    both = waits.join(firsts, F.col("to") == firsts["part"]).select("doc_id", "text", "following", "print_next")
    arrow = arrow_schema(SCHEMA)

    def run(batches):
        def rows():
            for batch in batches:
                for doc_id, text, following, print_next in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following", "print_next"))):
                    prefixes = Prefixes(text)
                    yield finished(doc_id, text, prefixes, fingerprint(prefixes), following, print_next)

        yield from batches_of(rows(), arrow)

    return both.mapInArrow(run, SCHEMA)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per row of docs: see SCHEMA.

    The next document is the one after in descending doc_id (null ids come last;
    equal ids follow each other by a hash of their texts); after the last comes the
    first. A null text counts as empty; two empty texts are alike (1.0), an empty
    and another are not (0.0). Equal rows are all kept; an empty table gives no rows,
    a single row is its own next; other columns are not read. A very long text takes
    some eighty bytes a code point of memory while it is hashed.
    """
    passed = scratch(in_order(docs))
    columns = [c for c in passed.columns if c not in ("state", "part", "text")]
    return passed.filter(F.col("state") == DONE).select(*columns).unionByName(joined_ends(passed))


def op2_fingerprints(spark, sf_dir):
    return fingerprint_documents(read_table(spark, sf_dir, "documents"))
