"""Raw provider records to canonical rows and payloads.

A record is one JSON text. It is parsed once, into a map of VARIANT values; its
entries are looked up in a table of aliases (entity, field, alias, priority,
consumed), which reaches every task as one map, so that another provider's names are
rows, not code. All of it is done inside the record's row, no entry is shuffled: of a
field's aliases the one with the least priority that has a value wins. What no
consumed alias names stays in the metadata. Values come back as text, with JSON for
arrays and objects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealforge.functions import offers as of
from dealforge.functions import text as tx

# The names under which a record may hold a field, in order of preference.
STORE = {
    "campaign_id": ("CampaignId", "ProgramId"), "advertiser_id": ("AdvertiserId",), "id": ("Id",), "name": ("CampaignName", "Name", "AdvertiserName"),
    "description": ("CampaignDescription", "Description"), "website": ("CampaignUrl", "Url", "AdvertiserUrl", "LandingPageUrl"), "logo": ("CampaignLogoUri", "LogoUri", "Logo", "ImageUrl"),
    "categories": ("Categories", "Category", "Vertical", "Verticals"), "country": ("Country", "CountryCode", "AdvertiserCountry"), "status": ("ContractStatus", "Status", "State"),
    "commission": ("ContractCommission", "PayoutType", "Commission", "DefaultPayout"), "tracking_link": ("TrackingLink", "TrackingUrl"),
}
OFFER = {
    "id": ("PromotionIds", "Id", "PromotionId", "AdId"), "title": ("PromotionTitle", "Name", "Title", "Description"), "campaign_id": ("CampaignId", "ProgramId"), "advertiser_id": ("AdvertiserId",),
    "description": ("Description", "ShortDescription"), "effective": ("PromotionEffectiveDates",), "start": ("StartDate", "CreationDate", "EffectiveDate"), "end": ("EndDate", "ExpirationDate", "ExpiryDate"),
    "tracking_url": ("TrackingLink", "TrackingUrl", "LandingPageUrl", "Url", "ClickUrl"), "status": ("State", "Status"),
}
# What only coupons consume, and what is read but stays in the metadata.
CODE_FIELDS = {
    "code": ("GenericRedemptionCode", "PromoCode", "CouponCode", "Code", "DiscountCode", "Coupon"), "percent": ("DiscountPercent", "PercentOff", "Percentage"),
    "amount": ("DiscountAmount", "AmountOff", "FlatAmount", "Value"), "terms": ("Terms", "TermsAndConditions", "Restrictions"),
}
READ_ONLY = {"offer_kind": ("PromoType", "Type", "PromotionType", "OfferType"), "offer_words": ("Name", "Description"), "uri": ("Uri", "PromotionItemsUri")}
CATEGORY = {"id": ("Id", "CatalogId", "CategoryId"), "name": ("Name", "CatalogName", "CategoryName"), "parent_id": ("ParentId", "ParentCategoryId", "CampaignId")}

ALIASES = "entity string, field string, alias string, priority int, consumed boolean"


def alias_table(spark: SparkSession) -> DataFrame:
    """ALIASES of the known provider; aliases in lower case. Rows of further providers may be added."""
    parts = [("store", STORE, True), ("coupon", OFFER | CODE_FIELDS, True), ("coupon", READ_ONLY, False), ("category", CATEGORY, True)]
    rows = [(entity, field, alias.lower(), place, consumed) for entity, fields, consumed in parts for field, aliases in fields.items() for place, alias in enumerate(aliases)]
    return spark.createDataFrame(rows, ALIASES)


def entries(record: Column) -> Column:
    """The entries of a JSON object in the order of the text, values as VARIANT; null for what is no object."""
    return F.map_entries(F.from_json(record, "map<string,variant>"))


def kind_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_nested(value: Column) -> Column:
    return kind_of(value).rlike("^(ARRAY|OBJECT)")


def settled(df: DataFrame, *kept: str, **made: Column) -> DataFrame:
    """The kept columns and the made ones, each made once a row.

    A generator of one row: what follows reads its outcome, whereas filters and columns
    over a projection would repeat the expressions, until they are too long to compile.
    """
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(name) for name, c in made.items()]))))


def last_of_each(pairs: Column, key: str) -> Column:
    """Of the structs with one key the last, as in a map that is written to in turn."""
    later = lambda i: F.slice(pairs, i + 2, F.size(pairs))
    return F.filter(pairs, lambda p, i: ~F.exists(later(i), lambda q: q[key] == p[key]))


def picked(records: DataFrame, aliases: DataFrame, *carried: str) -> DataFrame:
    """carried columns (a record's key first), is_object, fields (field -> text and json) and metadata of records (column record).

    aliases: those of one entity. Keys match in any case; of keys that differ in case
    only the last one counts. A null or empty value is none. Every record gives a row,
    also one without entries. A record in which an object inside names a key twice has
    no VARIANT form and counts as no object.
    """
    key = carried[0]
    hits = aliases.filter("alias is not null").groupBy("alias").agg(F.collect_list(F.struct("field", "priority", F.coalesce("consumed", F.lit(False)).alias("consumed"))).alias("hits"))
    known = hits.agg(F.map_from_entries(F.collect_list(F.struct("alias", "hits"))).alias("known"))
    # a record is longer than what a table keeps of it: a file of few rows a byte makes many tasks
    parsed = settled(records.repartition(key), *carried, pairs=entries(F.col("record")))
    named = F.transform("pairs", lambda e: F.struct(F.lower(e["key"]).alias("lower"), e["key"].alias("key"), e["value"].alias("value"), kind_of(e["value"]).alias("kind")))
    lower = F.transform("pairs", lambda e: F.lower(e["key"]))
    named = settled(parsed, *carried, is_object=F.col("pairs").isNotNull(), named=named, twice=F.size(F.array_distinct(lower)) < F.size(lower))
    of_each = F.when(F.col("twice"), last_of_each(F.col("named"), "lower")).otherwise(F.col("named"))
    text = lambda e: F.when(~e["kind"].rlike("^(ARRAY|OBJECT)"), F.try_variant_get(e["value"], "$", "string"))
    plain = F.transform(of_each, lambda e: F.struct(e["key"].alias("key"), text(e).alias("text"), F.to_json(e["value"]).alias("json"), (e["kind"] == "VOID").alias("void"), F.try_element_at("known", e["lower"]).alias("hits")))
    told = settled(named.crossJoin(F.broadcast(known)), *carried, "is_object", told=plain)
    valued = F.filter("told", lambda e: e["hits"].isNotNull() & ~e["void"] & (F.coalesce(e["text"], F.lit("-")) != ""))
    offered = F.flatten(F.transform(valued, lambda e: F.transform(F.filter(e["hits"], lambda h: h["field"].isNotNull()), lambda h: F.struct(h["field"].alias("field"), h["priority"].alias("priority"), F.struct(e["text"].alias("text"), e["json"].alias("json")).alias("value")))))
    unused = F.filter("told", lambda e: ~F.coalesce(F.exists(e["hits"], lambda h: h["consumed"]), F.lit(False)))
    metadata = F.map_from_entries(F.transform(unused, lambda e: F.struct(e["key"].alias("key"), F.coalesce(e["text"], e["json"]).alias("value"))))
    sorted_ = settled(told, *carried, "is_object", offered=F.array_sort(offered), metadata=F.coalesce(metadata, F.create_map().cast("map<string,string>")))
    first = F.filter("offered", lambda o, i: (i == 0) | (F.get("offered", i - 1)["field"] != o["field"]))
    fields = F.map_from_entries(F.transform(first, lambda o: F.struct(o["field"].alias("field"), F.struct(tx.as_string(o["value"]["text"]).alias("text"), o["value"]["json"].alias("json")).alias("value"))))
    return settled(sorted_, *carried, "is_object", "metadata", fields=F.coalesce(fields, F.create_map().cast("map<string,struct<text:string,json:string>>"))).select(*carried, "is_object", "fields", "metadata")


def field(name: str) -> Column:
    """A field's trimmed text; null if it is missing, blank, an array or an object."""
    return F.try_element_at("fields", F.lit(name))["text"]


def list_field(name: str) -> Column:
    """A field's texts: of an array its blank-free ones, of a text its parts."""
    value = F.try_element_at("fields", F.lit(name))
    of_array = F.filter(F.transform(F.from_json(value["json"], "array<variant>"), lambda v: F.when(~is_nested(v), F.trim(F.try_variant_get(v, "$", "string")))), lambda s: F.coalesce(s, F.lit("")) != "")
    return F.coalesce(F.when(F.substring(value["json"], 1, 1) == "[", of_array), tx.string_list(value["text"]), F.array().cast("array<string>"))


def with_entries(metadata: Column, **more: Column) -> Column:
    """metadata with entries whose values are not null; they replace entries of the same key."""
    made = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in more.items()]))
    old = F.filter(F.map_entries(metadata), lambda e: ~F.exists(made, lambda m: m["key"] == e["key"]))
    return F.map_from_entries(F.concat(old, made))


def split_issues(rows: DataFrame, entity: Column, index: str, ids: Column, missing: str, names: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows without an issue, A25: entity, index, reason of the others)."""
    title = F.initcap(entity)
    reason = (
        F.when(~F.col("is_object"), F.concat(title, F.lit(" record is not an object"))).when(ids.isNull(), F.concat(title, F.lit(f" record is missing {missing}")))
        .when(names.isNull(), F.concat(title, F.lit(" "), ids, F.lit(f" is missing a {name}")))
    )
    marked = settled(rows, *rows.columns, __entity=entity, __reason=reason)
    return marked.filter("__reason is null").drop("__entity", "__reason"), marked.filter("__reason is not null").select(F.col("__entity").alias("entity"), F.col(index).alias("index"), F.col("__reason").alias("reason"))


def normalize_stores(records: DataFrame, aliases: DataFrame, index: str = "index") -> tuple[DataFrame, DataFrame]:
    """(canonical stores, issues) of records (index, record)."""
    rows = picked(records, aliases.filter("entity = 'store'"), index)
    ids = F.coalesce(field("campaign_id"), field("id"), field("advertiser_id"))
    good, issues = split_issues(rows, F.lit("store"), index, ids, "CampaignId/Id", field("name"), "name")
    raw_logo, logo = field("logo"), of.logo_url(field("logo"))
    warning = F.when(raw_logo.isNotNull() & logo.isNull(), "logo could not be resolved to an absolute http(s) url")
    return good.select(
        index, ids.alias("provider_entity_id"), F.coalesce(field("campaign_id"), ids).alias("campaign_id"), field("advertiser_id").alias("advertiser_id"), field("name").alias("name"),
        field("description").alias("description"), field("website").alias("website"), logo.alias("logo"), list_field("categories").alias("categories"), field("country").alias("country"),
        of.map_status(field("status")).alias("status"), field("commission").alias("commission"),
        with_entries(F.col("metadata"), trackingLink=field("tracking_link"), originalLogo=raw_logo, logoWarning=warning).alias("metadata"),
    ), issues


def normalize_categories(records: DataFrame, aliases: DataFrame, index: str = "index") -> tuple[DataFrame, DataFrame]:
    """(canonical categories, issues) of records (index, record)."""
    rows = picked(records, aliases.filter("entity = 'category'"), index)
    good, issues = split_issues(rows, F.lit("category"), index, field("id"), "Id", field("name"), "name")
    return good.select(index, field("id").alias("provider_entity_id"), field("name").alias("name"), field("parent_id").alias("parent_id"), "metadata"), issues


def store_links(stores: DataFrame) -> DataFrame:
    """key, url: the tracking links of canonical stores, by advertiser and by campaign; of stores that share a key the last one's."""
    keys = F.explode(F.array_compact(F.array("advertiser_id", "campaign_id")))
    link = F.try_element_at("metadata", F.lit("trackingLink"))
    return stores.filter(link.isNotNull()).select(keys.alias("key"), F.col("index"), link.alias("url")).groupBy("key").agg(F.max_by("url", "index").alias("url"))


#: What the enrichment of an offer may add, by record.
ENRICHMENT = "code string, discount_type string, discount_value double, description string, start_date timestamp, end_date timestamp, ad_url string, campaign_url string, terms string"


def normalize_offers(records: DataFrame, aliases: DataFrame, links: DataFrame | None = None, enrichment: DataFrame | None = None, index: str = "index") -> tuple[DataFrame, DataFrame]:
    """(canonical offers with kind coupon or deal, issues) of records (index, record).

    A record with a usable code is a coupon (U3). links: store_links of the stores;
    enrichment: index and columns of ENRICHMENT.
    """
    coupon = aliases.filter("entity = 'coupon'")
    # which of both an offer is decides what its metadata keeps: coupons consume more names
    all_rows = picked(records, coupon.withColumn("consumed", F.col("consumed") & ~F.col("field").isin(*CODE_FIELDS)), index)
    if enrichment is None:
        all_rows = all_rows.withColumn("__more", F.from_json(F.lit(None).cast("string"), ENRICHMENT))
    else:
        all_rows = all_rows.join(enrichment.select(F.col(index), F.struct(*[c for c in enrichment.columns if c != index]).alias("__more")), index, "left")
    more = lambda name: F.col("__more")[name]
    coded = settled(all_rows, *all_rows.columns, __code=of.offer_code(field("code"), more("code")))
    code = F.col("__code")
    kinds = settled(coded, *coded.columns, kind=F.when(of.usable_code(code).isNotNull(), "coupon").otherwise("deal"))
    code_aliases = F.array(*[F.lit(a.lower()) for names in CODE_FIELDS.values() for a in names])
    metadata = F.when(F.col("kind") == "coupon", F.map_filter("metadata", lambda k, _: ~F.array_contains(code_aliases, F.lower(k)))).otherwise(F.col("metadata"))
    offers, issues = split_issues(kinds.withColumn("metadata", metadata), F.col("kind"), index, field("id"), "PromotionIds", field("title"), "title")
    base = of.discount_of(of.as_number(field("percent")), of.as_number(field("amount")), F.concat_ws(" ", field("offer_kind"), field("offer_words")))
    enriched = (F.col("__base.type") == "unknown") | ((F.col("__base.type") == "other") & more("discount_type").isNotNull())
    dates = of.date_range(field("effective"))
    offers = settled(offers, *offers.columns, __base=base, __dates=dates)
    if links is not None:
        for name in ("advertiser", "campaign"):
            offers = offers.withColumn(f"__{name}", field(f"{name}_id")).join(links.select(F.col("key").alias(f"__{name}"), F.col("url").alias(f"__{name}_url")), f"__{name}", "left")
        from_store = F.coalesce("__advertiser_url", "__campaign_url")
    else:
        from_store = F.lit(None).cast("string")
    tracking = of.tracking(more("ad_url"), field("tracking_url"), from_store, field("uri"), more("campaign_url"))
    offers = settled(offers, *offers.columns, __tracking=tracking)
    only_coupon = lambda c: F.when(F.col("kind") == "coupon", c)
    return offers.select(
        index, "kind", field("id").alias("provider_entity_id"), F.coalesce(field("advertiser_id"), field("campaign_id")).alias("store_provider_id"), field("advertiser_id").alias("advertiser_id"),
        field("campaign_id").alias("campaign_id"), field("title").alias("title"), F.coalesce(field("description"), more("description")).alias("description"), only_coupon(code).alias("code"),
        only_coupon(F.when(F.coalesce(enriched, F.lit(False)), F.coalesce(more("discount_type"), F.col("__base.type"))).otherwise(F.col("__base.type"))).alias("discount_type"),
        only_coupon(F.coalesce("__base.value", more("discount_value"))).alias("discount_value"),
        F.coalesce(of.as_timestamp(field("start")), F.col("__dates.start"), more("start_date")).alias("start_date"), F.coalesce(of.as_timestamp(field("end")), F.col("__dates.end"), more("end_date")).alias("end_date"),
        F.col("__tracking.url").alias("tracking_url"), only_coupon(F.coalesce(field("terms"), more("terms"))).alias("terms"), of.map_status(field("status")).alias("status"),
        with_entries(F.col("metadata"), trackingUrlWarning=F.col("__tracking.warning")).alias("metadata"),
    ), issues


# The sentences of generated descriptions, for a store's name, an offer's title and a site's name.
STORE_DESCRIPTION = "Save more with verified {store} coupons, promo codes and exclusive deals updated regularly on {brand}."
OFFER_DESCRIPTION = "Save with {store} using this verified offer: {title}. Updated regularly on {brand}."


def sentence(template: str, **values: Column) -> Column:
    """A template with its names replaced by columns."""
    parts = []
    for piece in template.split("{"):
        name, closed, rest = piece.partition("}")
        parts += [values[name], F.lit(rest)] if closed else [F.lit(piece)]
    return F.concat(*parts)


def store_payload(stores: DataFrame, site: str, brand: str, year: int) -> DataFrame:
    """K2: catalogue rows of canonical stores with a slug: regions and logo source from the metadata, SEO defaults."""
    meta = lambda *names: F.coalesce(*[F.try_element_at("metadata", F.lit(n)) for n in names])
    regions = F.filter(F.from_json(meta("shippingRegions", "ShippingRegions"), "array<string>"), lambda r: F.trim(r) != "")
    return stores.select(
        "provider_entity_id", "name", "slug", "description", F.col("logo").alias("logo_url"), F.coalesce(tx.as_string(meta("originalLogo")), "logo").alias("logo_source_url"),
        F.col("website").alias("affiliate_url"), F.lit(None).cast("string").alias("category_provider_id"), "country", F.coalesce(regions, F.array().cast("array<string>")).alias("shipping_regions"), "metadata",
        of.store_seo_title(F.col("name"), year, brand).alias("seo_title"), sentence(STORE_DESCRIPTION, store=F.col("name"), brand=F.lit(brand)).alias("seo_description"),
        of.canonical_url(site, F.col("slug")).alias("seo_canonical_url"),
    )


def store_index(stores: DataFrame) -> DataFrame:
    """key, store (name, slug): stores by each of their ids; of stores that share a key the last one."""
    keys = F.explode(F.array_distinct(F.array_compact(F.array("provider_entity_id", "advertiser_id", "campaign_id"))))
    return stores.select(keys.alias("key"), "index", F.struct("name", "slug").alias("store")).groupBy("key").agg(F.max_by("store", "index").alias("store"))


def offer_payload(offers: DataFrame, stores: DataFrame, today: str, site: str, brand: str, year: int) -> DataFrame:
    """K2: catalogue rows of canonical offers: window status, the store's name and page, SEO defaults.

    The store is found by advertiser, by the offer's own reference, then by campaign:
    three joins with one row a key.
    """
    index, out, found = store_index(stores), offers, []
    for i, name in enumerate(("advertiser_id", "store_provider_id", "campaign_id")):
        out = out.join(index.select(F.col("key").alias(f"__k{i}"), F.col("store").alias(f"__s{i}")), F.col(name) == F.col(f"__k{i}"), "left")
        found.append(F.col(f"__s{i}"))
    out = out.withColumn("__store", F.coalesce(*found))
    meta = lambda name: F.try_element_at("metadata", F.lit(name))
    store = F.coalesce("__store.name", tx.as_string(meta("advertiserName")), F.lit("this store"))
    day = F.lit(today).cast("date")
    status = of.offer_status(F.col("status"), F.to_date("start_date"), F.to_date("end_date"), day)
    return out.select(
        "provider_entity_id", "store_provider_id", "title", "description", F.when(F.col("kind") == "coupon", F.col("code")).alias("coupon_code"),
        F.when(F.col("kind") == "coupon", "code").otherwise("deal").alias("coupon_type"), F.col("tracking_url").alias("affiliate_url"), F.to_date("end_date").alias("expiry_date"), F.to_date("start_date").alias("start_date"),
        F.when(meta("isPubliclyAvailable") == "false", "draft").otherwise(status).alias("status"), "terms", "discount_type", "discount_value", tx.as_string(meta("landingPageUrl")).alias("landing_page_url"), "metadata",
        of.coupon_seo_title(F.col("title"), store, year, brand).alias("seo_title"), sentence(OFFER_DESCRIPTION, store=store, title=F.col("title"), brand=F.lit(brand)).alias("seo_description"),
        of.canonical_url(site, F.col("__store.slug"), tx.seo_slug(F.col("title"))).alias("seo_canonical_url"),
    )
