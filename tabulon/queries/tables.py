"""Queries over flat tables: filters, groups, profiles, lookups, search."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators import lookup, search
from tabulon.operators.profile import profile, tally
from tabulon.operators.query import Aggregate as A
from tabulon.operators.query import Filter, Query, matching, scan_counts
from tabulon.operators.query import query as ask
from tabulon.plans.keep import folder
from tabulon.queries import query
from tabulon.sources.index import Index
from tabulon.sources.tables import read, wide
from tabulon.values import cell, error, shown_column

SHOWN = "CAST(format('{{:.14e}}', {0}) AS DOUBLE)"


def shown(x: str) -> str:
    return SHOWN.format(f"CAST({x} AS DOUBLE)")


# --- the flagship ------------------------------------------------------------------------------
FLAGSHIP = Query((Filter("l_returnflag", "is", "a"),), ("l_linestatus",), (A("count"), A("sum", "l_quantity"), A("mean", "l_quantity"), A("min", "l_extendedprice"), A("max", "l_extendedprice")), None, ("n", "sum_qty", "avg_qty", "min_price", "max_price"))


@query("qt_flagship", f"SELECT l_linestatus, count(*) AS n, {shown('sum(l_quantity)')} AS sum_qty, {shown('avg(l_quantity)')} AS avg_qty, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price FROM lineitem WHERE lower(l_returnflag) = 'a' GROUP BY l_linestatus")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask(wide(spark, sf_dir, "lineitem"), FLAGSHIP)


# --- filters -----------------------------------------------------------------------------------
# Orders with planted blanks, texts and errors: a price cell that is sometimes no number.
MIXED = """(SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 47 = 0 THEN 'empty' WHEN o_orderkey % 53 = 0 THEN 'text' WHEN o_orderkey % 59 = 0 THEN 'error' WHEN o_orderkey % 61 = 0 THEN 'bool' ELSE 'number' END AS kind,
  CASE WHEN o_orderkey % 47 = 0 OR o_orderkey % 53 = 0 OR o_orderkey % 59 = 0 OR o_orderkey % 61 = 0 THEN NULL ELSE o_totalprice END AS num,
  CASE WHEN o_orderkey % 47 <> 0 AND o_orderkey % 53 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'N/a' END END AS txt FROM orders) m"""


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    none = F.lit(None).cast("double")
    price = F.when(k % 47 == 0, cell("number", none)).when(k % 53 == 0, cell("text", F.when(k % 2 == 0, "").otherwise("N/a"))).when(k % 59 == 0, error("#REF!")).when(k % 61 == 0, cell("bool", F.lit(True))).otherwise(cell("number", F.col("o_totalprice")))
    return o.select("o_orderkey", "o_custkey", price.alias("price"))


def mixed_table(spark, sf_dir):
    from tabulon.operators.query import Table

    return Table(mixed(spark, sf_dir), "orders", (), "o_orderkey")


LIKE = "CASE kind WHEN 'number' THEN num WHEN 'bool' THEN 1.0 END"
TESTS = {
    "is": ("price", "is", "n/A", "kind = 'text' AND lower(txt) = 'n/a'"),
    "is_not": ("price", "is_not", "n/a", "NOT coalesce(kind = 'text' AND lower(txt) = 'n/a', false) AND kind <> 'error'"),
    "contains": ("price", "contains", "/A", "kind = 'text' AND contains(lower(txt), '/a')"),
    "one_of": ("price", "one_of", ["n/a", True], "(kind = 'text' AND lower(txt) = 'n/a') OR kind = 'bool'"),
    "above": ("price", "above", 200000, f"{LIKE} > 200000"),
    "at_least": ("price", "at_least", 1, f"{LIKE} >= 1"),
    "below": ("price", "below", 5000.5, f"{LIKE} < 5000.5"),
    "at_most": ("price", "at_most", 1, f"{LIKE} <= 1"),
    "blank": ("price", "blank", None, "kind = 'empty' OR txt = ''"),
    "not_blank": ("price", "not_blank", None, "NOT (kind = 'empty' OR coalesce(txt = '', false)) AND kind <> 'error'"),
    "failed": ("price", "failed", None, "kind = 'error'"),
}
for _name, (_column, _test, _value, _where) in TESTS.items():
    query(f"qt_filter_{_name}", f"SELECT o_orderkey, o_custkey FROM {MIXED} WHERE {_where}")(lambda spark, sf_dir, f=Filter(_column, _test, _value): matching(mixed_table(spark, sf_dir), (f,)).select("o_orderkey", "o_custkey"))


@query("qt_filter_fifteen_digits", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount FROM lineitem WHERE " + shown("l_discount * 3") + " = 0.3")
def fifteen_digits(spark, sf_dir):
    from tabulon.operators.query import Table

    t = Table(read(spark, sf_dir, "lineitem").withColumn("third", F.col("l_discount") * 3))
    return matching(t, (Filter("third", "is", 0.3),)).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")


@query("qt_filter_errors_counted", f"SELECT count(*) AS rows_scanned, count(*) FILTER (WHERE o_custkey >= 100 AND {LIKE} > 1000) AS rows_matched, count(*) FILTER (WHERE o_custkey >= 100 AND kind = 'error') AS rows_with_errors FROM {MIXED}")
def errors_counted(spark, sf_dir):
    return scan_counts(mixed_table(spark, sf_dir), (Filter("o_custkey", "at_least", 100), Filter("price", "above", 1000)))


# --- aggregates --------------------------------------------------------------------------------
def asked(name, table, row, q, sql):
    query(name, sql)(lambda spark, sf_dir: ask(wide(spark, sf_dir, table, row), q))


asked("qt_agg_count", "lineitem", None, Query((), ("l_returnflag", "l_linestatus"), (A("count"),), None, ("n",)), "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
asked("qt_agg_values", "documents", None, Query((), ("lang",), (A("count_values", "text"),), None, ("n",)), "SELECT lang, count(*) FILTER (WHERE text <> '') AS n FROM documents GROUP BY lang")
asked("qt_agg_distinct", "orders", None, Query((), ("o_orderstatus",), (A("count_distinct", "o_custkey"), A("count_distinct", "o_orderpriority")), None, ("customers", "priorities")), "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT lower(o_orderpriority)) AS priorities FROM orders GROUP BY 1")
asked("qt_agg_sum_mean", "customer", None, Query((), ("c_mktsegment",), (A("sum", "c_acctbal"), A("mean", "c_acctbal")), None, ("total", "mean")), f"SELECT c_mktsegment, {shown('round(sum(c_acctbal), 4)')} AS total, {shown('round(avg(c_acctbal), 6)')} AS mean FROM customer GROUP BY 1")
asked("qt_agg_extremes", "orders", "o_orderkey", Query((), ("o_orderpriority",), (A("min", "o_totalprice"), A("max", "o_totalprice")), None, ("low", "high")), "SELECT min(o_orderpriority) AS o_orderpriority, min(o_totalprice) AS low, min_by(o_orderkey, (o_totalprice, o_orderkey)) AS \"low at\", max(o_totalprice) AS high, min_by(o_orderkey, (-o_totalprice, o_orderkey)) AS \"high at\" FROM orders GROUP BY lower(o_orderpriority)")
asked("qt_agg_first_seen", "orders", "o_orderkey", Query((), ("o_custkey",), (A("count"),), 7, ("n",)), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY min(o_orderkey) LIMIT 7")
asked("qt_agg_ungrouped", "lineitem", None, Query((Filter("l_quantity", "at_most", 5),), (), (A("count"), A("max", "l_tax")), None, ("n", "top")), "SELECT count(*) AS n, max(l_tax) AS top FROM lineitem WHERE l_quantity <= 5")
asked("qt_agg_no_rows", "lineitem", None, Query((Filter("l_returnflag", "is", "none"),), (), (A("count"),), None, ("n",)), "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'none' HAVING count(*) > 0")
asked("qt_agg_number_keys", "part", None, Query((), ("p_retailprice",), (A("count"),), None, ("n",)), f"SELECT min(p_retailprice) AS p_retailprice, count(*) AS n FROM part GROUP BY {shown('p_retailprice')}")


def _rounded(df, places):
    return df.select(*[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in df.columns])


@query("qt_agg_sum_mean", f"SELECT c_mktsegment, round({shown('sum(c_acctbal)')}, 4) AS total, round({shown('avg(c_acctbal)')}, 6) AS mean FROM customer GROUP BY 1")
def sum_mean(spark, sf_dir):
    q = Query((), ("c_mktsegment",), (A("sum", "c_acctbal"), A("mean", "c_acctbal")), None, ("total", "mean"))
    return _rounded(ask(wide(spark, sf_dir, "customer"), q), {"total": 4, "mean": 6})


@query("qt_agg_typed_groups", f"SELECT kind, value, count(*) AS n, min(o_orderkey) AS first FROM (SELECT o_orderkey, kind, CASE kind WHEN 'number' THEN CAST(CAST(floor(num / 100000) AS BIGINT) AS VARCHAR) WHEN 'text' THEN lower(txt) WHEN 'bool' THEN 'true' WHEN 'error' THEN '#REF!' ELSE '' END AS value FROM {MIXED}) GROUP BY 1, 2")
def typed_groups(spark, sf_dir):
    from tabulon.operators.query import Table

    p = F.col("price")
    banded = mixed(spark, sf_dir).withColumn("band", F.when(p["kind"] == "number", cell("number", F.floor(p["num"] / 100000))).otherwise(p))
    out = ask(Table(banded, "t", (), "o_orderkey"), Query((), ("band",), (A("count"), A("min", "o_orderkey")), None, ("n", "first")))
    b = F.col("band")
    value = F.when(b["kind"] == "number", b["num"].cast("bigint").cast("string")).when(b["kind"] == "text", F.lower(b["txt"])).when(b["kind"] == "bool", "true").when(b["kind"] == "error", b["err"]).otherwise("")
    return out.select(b["kind"].alias("kind"), value.alias("value"), "n", F.col("first").cast("bigint").alias("first"))


@query("qt_agg_errors", f"SELECT count(*) FILTER (WHERE kind = 'error') * 2 AS errors, count(*) AS n, round({shown('sum(num)')}, 4) AS total FROM {MIXED}")
def agg_errors(spark, sf_dir):
    out = ask(mixed_table(spark, sf_dir), Query((), (), (A("count"), A("sum", "price"), A("count_values", "price")), None, ("n", "total", "values")))
    return out.select("errors", "n", F.round("total", 4).alias("total"))


# --- profiles ----------------------------------------------------------------------------------
def profile_sql(table: str, columns: dict[str, str]) -> str:
    parts = []
    for i, (c, kind) in enumerate(columns.items()):
        num = f"CAST({c} AS DOUBLE)" if kind == "number" else "NULL::DOUBLE"
        key = shown(c) if kind == "number" else c
        parts.append(f"SELECT {i} AS position, '{c}' AS name, '{kind}' AS kind, count({c}) AS populated, count(*) - count({c}) AS empty, CASE WHEN count(DISTINCT {key}) <= 1024 THEN count(DISTINCT {key}) END AS \"distinct\", (count(DISTINCT {key}) <= 64 AND count({c}) >= 2 * count(DISTINCT {key})) AS categorical, min({num}) AS min, max({num}) AS max, round(sum({num}), 3) AS sum, round(avg({num}), 6) AS mean FROM {table}")
    return " UNION ALL ".join(parts)


PROFILED = {
    "customer": {"c_custkey": "number", "c_name": "text", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "text"},
    "orders": {"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "text", "o_totalprice": "number", "o_orderpriority": "text"},
    "labels": {"doc_id": "number", "quality": "number", "toxic": "number"},
}
for _table, _columns in PROFILED.items():

    @query(f"profile_{_table}", profile_sql(_table, _columns))
    def _profile(spark, sf_dir, name=_table, columns=tuple(_columns)):
        from tabulon.operators.query import Table

        out = profile(Table(read(spark, sf_dir, name).select(*columns)))
        return out.select("position", "name", "kind", "populated", "empty", "distinct", "categorical", "min", "max", F.round("sum", 3).alias("sum"), F.round("mean", 6).alias("mean"))


@query("profile_values", "SELECT o_orderstatus AS value, count(*) AS count FROM orders GROUP BY 1")
def profile_values(spark, sf_dir):
    from tabulon.operators.query import Table

    out = profile(Table(read(spark, sf_dir, "orders").select("o_orderstatus")))
    return out.select(F.explode("values").alias("v")).select("v.value", "v.count")


@query("tally_orders", f"SELECT 0 AS position, 'o_orderkey' AS name, count(*) AS populated, 'number' AS kind FROM orders UNION ALL SELECT 1, 'o_custkey', count(*), 'number' FROM orders UNION ALL SELECT 2, 'price', count(*) FILTER (WHERE kind <> 'empty'), 'number' FROM {MIXED}")
def tally_orders(spark, sf_dir):
    from tabulon.operators.query import Table

    return tally(Table(mixed(spark, sf_dir))).select("position", "name", "populated", "kind")


# --- lookups -----------------------------------------------------------------------------------
@query("lookup_exact", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, p_brand AS found FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def lookup_exact(spark, sf_dir):
    out = lookup.exact(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), "l_partkey", read(spark, sf_dir, "part"), "p_partkey", "p_brand", "p_partkey")
    return out.withColumn("found", F.col("found.txt"))


@query("lookup_first_match", "SELECT p_partkey, p_brand, (SELECT min(q.p_partkey) FROM part q WHERE lower(q.p_brand) = lower(part.p_brand)) AS found FROM part")
def lookup_first_match(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lookup.exact(part, "p_brand", part, "p_brand", "p_partkey", "p_partkey").withColumn("found", F.col("found.num").cast("bigint"))


@query("lookup_missing_na", "SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN '#N/A' ELSE c_name END AS found FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON o_custkey = c_custkey")
def lookup_missing(spark, sf_dir):
    some = read(spark, sf_dir, "customer").filter("c_custkey % 3 = 0")
    out = lookup.exact(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", some, "c_custkey", "c_name", "c_custkey")
    return out.select("o_orderkey", F.coalesce("found.txt", "found.err").alias("found"))


BANDS = [(0, 0.02), (50_000, 0.10), (100_000, 0.25), (200_000, 0.5), (400_000, 0.85)]


@query("lookup_banding", "SELECT o_orderkey, CAST(CASE WHEN o_totalprice >= 400000 THEN 0.85 WHEN o_totalprice >= 200000 THEN 0.5 WHEN o_totalprice >= 100000 THEN 0.25 WHEN o_totalprice >= 50000 THEN 0.10 WHEN o_totalprice >= 0 THEN 0.02 END AS DOUBLE) AS found FROM orders")
def lookup_banding(spark, sf_dir):
    bands = spark.createDataFrame([(i, float(a), b) for i, (a, b) in enumerate(BANDS)], "position long, start double, rate double")
    out = lookup.approximate(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", bands, "start", "rate", "position")
    return out.select("o_orderkey", F.col("found.num").alias("found"))


@query("lookup_as_of", "SELECT event_id, (SELECT max(o_orderkey) FROM orders WHERE o_totalprice <= value * 1000) AS found FROM events")
def lookup_as_of(spark, sf_dir):
    probes = read(spark, sf_dir, "events").select("event_id", (F.col("value") * 1000).alias("probe"))
    out = lookup.approximate(probes, "probe", read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", "o_orderkey")
    return out.select("event_id", F.col("found.num").cast("bigint").alias("found"))


@query("match_minus1", "SELECT o_orderkey, CASE WHEN o_totalprice <= 0 THEN 5 WHEN o_totalprice <= 50000 THEN 4 WHEN o_totalprice <= 100000 THEN 3 WHEN o_totalprice <= 200000 THEN 2 WHEN o_totalprice <= 400000 THEN 1 END AS place FROM orders")
def match_minus1(spark, sf_dir):
    bands = spark.createDataFrame([(i, float(a), i + 1) for i, (a, _) in enumerate(reversed(BANDS))], "position long, start double, place int")
    out = lookup.approximate(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", bands, "start", "place", "position", below=False)
    return out.select("o_orderkey", F.col("found.num").cast("int").alias("place"))


@query("match_exact", "SELECT n_nationkey, (SELECT min(r_regionkey) + 1 FROM region WHERE r_regionkey = n_regionkey) AS place FROM nation")
def match_exact(spark, sf_dir):
    out = lookup.match_exact(read(spark, sf_dir, "nation"), "n_regionkey", read(spark, sf_dir, "region"), "r_regionkey", "r_regionkey")
    return out.select("n_nationkey", F.col("place.num").cast("int").alias("place"))


@query("lookup_wildcard", "SELECT r_name, (SELECT min_by(c_custkey, c_custkey) FROM customer WHERE c_name ILIKE '%' || r_regionkey || '_') AS found FROM region")
def lookup_wildcard(spark, sf_dir):
    region = read(spark, sf_dir, "region").select("r_name", F.concat(F.lit("*"), F.col("r_regionkey").cast("string"), F.lit("?")).alias("pattern"))
    out = lookup.wildcard_join(region, "pattern", read(spark, sf_dir, "customer"), "c_name", "c_custkey", "c_custkey")
    return out.select("r_name", F.col("found.num").cast("bigint").alias("found"))


@query("index_match", "SELECT c_custkey, n_name AS found FROM customer JOIN nation ON c_nationkey = n_nationkey")
def index_match(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    place = lookup.match_exact(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", nation, "n_nationkey", "n_nationkey")
    rows = nation.withColumn("place_key", F.col("n_nationkey").cast("long") + 1)
    return lookup.index(place.withColumn("at", F.col("place.num")), F.col("at"), rows, "place_key", "n_name", 25).select("c_custkey", F.col("found.txt").alias("found"))


@query("hlookup", "SELECT r_regionkey, r_name AS found FROM region")
def hlookup(spark, sf_dir):
    sheet = lookup.transposed(read(spark, sf_dir, "region").withColumn("position", F.lit(0)), "r_regionkey", "position")
    probes = read(spark, sf_dir, "region").select("r_regionkey", F.lit("R_NAME").alias("wanted"))
    found = sheet.select("row_key", "header", "position", F.col("value.txt").alias("value"))
    got = probes.join(found, (probes.r_regionkey == found.row_key) & (F.lower("wanted") == F.lower("header")), "left")
    return got.select("r_regionkey", F.col("value").alias("found"))


# --- words and vectors -------------------------------------------------------------------------
TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '' AND strlen(w) <= 40)"


@query("tokenise", f"SELECT doc_id, len({TOKENS}) AS n, array_to_string({TOKENS}, ' ') AS words FROM documents")
def tokenise(spark, sf_dir):
    t = read(spark, sf_dir, "documents").select("doc_id", search.plain_words(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n"), F.array_join("t", " ").alias("words"))


@query(
    "lex_bm25",
    f"""WITH t AS (SELECT doc_id AS doc, {TOKENS} AS terms FROM documents),
    c AS (SELECT doc, len(terms) AS length, len(list_filter(terms, lambda w: w = 'the')) AS tf0, len(list_filter(terms, lambda w: w = 'und')) AS tf1 FROM t),
    s AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (WHERE tf0 > 0) AS df0, count(*) FILTER (WHERE tf1 > 0) AS df1 FROM c)
    SELECT doc, round(ln(1 + (n - df0 + 0.5) / (df0 + 0.5)) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * length / mean)) + ln(1 + (n - df1 + 0.5) / (df1 + 0.5)) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * length / mean)), 9) AS score FROM c, s WHERE tf0 > 0 OR tf1 > 0""",
)
def lex_bm25(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return search.bm25(docs, ["the", "und"], "text", search.plain_words(F.col("text"))).select("doc", F.round("score", 9).alias("score"))


@query("vec_normalise", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS norm, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) ** 2), 9) AS unit FROM embeddings")
def vec_normalise(spark, sf_dir):
    e = F.col("embedding")
    u = search.normalised(e)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(search.dot(e, e)), 9).alias("norm"), F.round(search.dot(u, u), 9).alias("unit"))


def first_vector(spark, sf_dir):
    row = read(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()
    return list(row[0])


VECTOR = "(SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)"


@query("vec_topk", f"SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], {VECTOR}), 9) AS score FROM embeddings ORDER BY list_dot_product(embedding::DOUBLE[], {VECTOR}) DESC, vec_id LIMIT 10")
def vec_topk(spark, sf_dir):
    return search.nearest(read(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 10).select("vec_id", F.round("score", 9).alias("score"))


@query(
    "rrf",
    f"""WITH v AS (SELECT vec_id, row_number() OVER (ORDER BY list_dot_product(embedding::DOUBLE[], {VECTOR}) DESC, vec_id) - 1 AS r FROM embeddings QUALIFY r < 50),
    l AS (SELECT vec_id, row_number() OVER (ORDER BY label DESC, vec_id) - 1 AS r FROM embeddings QUALIFY r < 50),
    u AS (SELECT vec_id, 1.0 / (60 + r + 1) AS s FROM v UNION ALL SELECT vec_id, 2.0 / (60 + r + 1) FROM l)
    SELECT vec_id, round(sum(s), 12) AS score FROM u GROUP BY 1 ORDER BY sum(s) DESC, vec_id LIMIT 10""",
)
def rrf(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    near = search.nearest(e, first_vector(spark, sf_dir), 50)
    label = e.select("vec_id", F.col("label").cast("double").alias("score"))
    return search.fuse([(near, 1.0), (label, search.LEXICAL)], "vec_id").select("vec_id", F.round("score", 12).alias("score"))


# Words that stemming and splitting leave as they are, so that SQL needs no stemmer: brands of parts and their types.
PARTS = "(SELECT p_partkey AS doc, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: w <> '') AS label, list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda w: w <> '') AS body, CAST(p_size AS BIGINT) AS cells FROM part)"
FOUND = ("red", "ring", "small")


def found_sql() -> str:
    """BM25 of each term in each field, boosted, times the size weight."""
    n = range(len(FOUND))
    count = ", ".join(f"len(list_filter({f}, lambda w: w = '{t}')) AS {f}{i}" for f in ("label", "body") for i, t in enumerate(FOUND))
    df = ", ".join(f"count(*) FILTER (WHERE {f}{i} > 0) AS d{f}{i}" for f in ("label", "body") for i in n)
    part = lambda f, i, b: f"CASE WHEN {f}{i} > 0 THEN {b} * ln(1 + (n - d{f}{i} + 0.5) / (d{f}{i} + 0.5)) * {f}{i} * 2.2 / ({f}{i} + 1.2 * (0.25 + 0.75 * n{f} / m{f})) ELSE 0 END"
    score = " + ".join(f"({part('label', i, 4.0)} + {part('body', i, 1.0)})" for i in n)
    return f"""WITH c AS (SELECT doc, cells, len(label) AS nlabel, len(body) AS nbody, {count} FROM {PARTS} p),
    s AS (SELECT count(*) AS n, avg(nlabel) AS mlabel, avg(nbody) AS mbody, {df} FROM c),
    r AS (SELECT doc, ({score}) * (1 + log10(1 + cells) / 4) AS score FROM c, s)
    SELECT doc, round(score, 6) AS score FROM r WHERE score > 0 ORDER BY r.score DESC, doc LIMIT 25"""


def part_docs(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("doc"), F.col("p_name").alias("label"), F.col("p_type").alias("body"), F.col("p_size").cast("bigint").alias("cells"), F.lit("column").alias("kind"), F.col("p_brand").alias("sheet"))


@query("lex_find", found_sql())
def lex_find(spark, sf_dir):
    return search.lexical(part_docs(spark, sf_dir), " ".join(FOUND), 25).select("doc", F.round("score", 6).alias("score"))


def part_index(spark, sf_dir, embed=None):
    """The parts as one stored workbook."""
    index = Index(spark, f"{folder(spark)}/index/{uuid4().hex}")
    index.put("parts", part_docs(spark, sf_dir).withColumns({"context": F.lit(""), "values": F.array().cast("array<string>"), "categorical": F.lit(False)}), embed, "letters")
    return index


@query("lex_find_stored", found_sql())
def lex_find_stored(spark, sf_dir):
    """The same through stored postings."""
    index = part_index(spark, sf_dir)
    return search.lexical(index.documents(), " ".join(FOUND), 25, scores=index.scores).select("doc", F.round("score", 6).alias("score"))


def letters(text):
    """A stand-in for an embedding model that SQL can state: how often each of some letters occurs."""
    return F.array(*[(F.length(text) - F.length(F.replace(text, F.lit(x), F.lit("")))).cast("double") for x in LETTERS])


LETTERS = "aeinorst"


def letters_sql(text: str) -> str:
    return "[" + ", ".join(f"CAST(len({text}) - len(replace({text}, '{x}', '')) AS DOUBLE)" for x in LETTERS) + "]"


@query(
    "fused_find_stored",
    f"""WITH w AS ({found_sql().replace("round(score, 6)", "r.score").replace("LIMIT 25", "LIMIT 50")}), l AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) - 1 AS rank FROM w),
    t AS (SELECT p_partkey AS doc, {letters_sql("concat('column ', p_name, ': ', p_type)")} AS v, {letters_sql("'" + " ".join(FOUND) + "'")} AS q FROM part),
    d AS (SELECT doc, list_transform(v, lambda x: CAST(x / sqrt(list_dot_product(v, v)) AS FLOAT)) AS v, list_transform(q, lambda x: x / sqrt(list_dot_product(q, q))) AS q FROM t),
    n AS (SELECT doc, row_number() OVER (ORDER BY {" + ".join(f"CAST(v[{i}] AS DOUBLE) * q[{i}]" for i in range(1, len(LETTERS) + 1))} DESC, doc) - 1 AS rank FROM d QUALIFY rank < 50),
    u AS (SELECT doc, 2.0 / (60 + rank + 1) AS s FROM l UNION ALL SELECT doc, 1.0 / (60 + rank + 1) FROM n)
    SELECT doc, round(sum(s), 12) AS score, count(*) AS lists FROM u GROUP BY 1 ORDER BY sum(s) DESC, doc LIMIT 20""",
)
def fused_find_stored(spark, sf_dir):
    """`find` with an embedder, words and vectors both stored."""
    hits, _ = search.find_stored(part_index(spark, sf_dir, letters), " ".join(FOUND), 20, letters, "letters")
    return hits.select("doc", F.round("score", 12).alias("score"), F.col("lists").cast("bigint").alias("lists"))


@query("lex_find_on_a_sheet", found_sql().replace("FROM part)", "FROM part WHERE p_brand = 'Brand#7')"))
def lex_find_on_a_sheet(spark, sf_dir):
    docs = search.filtered(part_docs(spark, sf_dir), ["column"], None, "Brand#7")
    return search.lexical(docs, " ".join(FOUND), 25).select("doc", F.round("score", 6).alias("score"))


@query("term_probes", "SELECT word, count(*) AS hits, min(doc) AS first FROM (SELECT w AS word, doc, row_number() OVER (PARTITION BY w ORDER BY cells DESC, doc) AS r FROM (VALUES ('red'), ('ring')) t(w) JOIN " + "(SELECT p_partkey AS doc, p_name, CAST(p_size AS BIGINT) AS cells FROM part) p" + " ON list_contains(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), w)) WHERE r <= 200 GROUP BY 1")
def term_probes(spark, sf_dir):
    """Every name has two words, so a word's score falls with the size weight alone."""
    docs = part_docs(spark, sf_dir).drop("body")
    return search.term_hits(docs, "what is the red ring").groupBy("word").agg(F.count("*").alias("hits"), F.min("doc").alias("first"))


@query(
    "fused_find",
    f"""WITH v AS (SELECT vec_id, row_number() OVER (ORDER BY list_dot_product(embedding::DOUBLE[], {VECTOR}) DESC, vec_id) - 1 AS r FROM embeddings QUALIFY r < 50),
    l AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings WHERE label = (SELECT label FROM embeddings ORDER BY vec_id LIMIT 1) QUALIFY r < 50),
    u AS (SELECT vec_id, 1.0 / (60 + r + 1) AS s FROM v UNION ALL SELECT vec_id, 2.0 / (60 + r + 1) FROM l)
    SELECT vec_id, round(sum(s), 12) AS score, count(*) AS lists FROM u GROUP BY 1 ORDER BY sum(s) DESC, vec_id LIMIT 20""",
)
def fused_find(spark, sf_dir):
    """The two halves of a search: words (here the label of the first vector) and vectors; `lists` tells the hits that both have."""
    e = read(spark, sf_dir, "embeddings")
    first = e.orderBy("vec_id").select("label").first()[0]
    word = e.filter(F.col("label") == first).select("vec_id", F.lit(1.0).alias("score"))
    near = search.nearest(e, first_vector(spark, sf_dir), 50)
    return search.fuse([(word, search.LEXICAL), (near, 1.0)], "vec_id", 20).select("vec_id", F.round("score", 12).alias("score"), F.col("lists").cast("bigint").alias("lists"))


@query("shown_numbers", f"SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, {shown('l_extendedprice * (1 - l_discount) / 7')} AS v FROM lineitem")
def shown_numbers(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", shown_column(F.col("l_extendedprice") * (1 - F.col("l_discount")) / 7).alias("v"))
