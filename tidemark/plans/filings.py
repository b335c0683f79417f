"""Registered queries on sources, text and changes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.catalog import register
from tidemark.functions import text as tx
from tidemark.operators import changes as ch
from tidemark.operators.ledger import lei_valid
from tidemark.sources import filings as src
from tidemark.tables import BARS, bars, table


@register("S07_index_lines", "SELECT c_custkey AS cik, c_name AS company, 'F' AS form, DATE '1995-01-01' + (c_custkey % 300)::INTEGER AS filed, n_name AS ticker FROM customer JOIN nation ON n_nationkey = c_custkey WHERE c_custkey % 3 = 0 AND c_custkey % 5 <> 0")
def s07(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    form = F.element_at(F.array(F.lit(" F "), F.lit("X"), F.lit("Y")), (F.col("c_custkey") % 3).cast("int") + 1)
    owner = F.when(F.col("c_custkey") % 5 == 0, F.col("c_custkey") + 1).otherwise(F.col("c_custkey"))
    lines = c.select(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", form, F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")).cast("string"), F.concat(F.lit("data/"), owner.cast("string"), F.lit("/x.txt"))).alias("value"))
    lines = lines.unionByName(c.select(F.lit("bad line").alias("value")).limit(3))
    names = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("cik"), F.col("n_name").alias("ticker"))
    return src.index_lines(lines, ("F",), names).select("cik", "company", "form", "filed", "ticker")


@register("S08_ticker_map", "SELECT n_regionkey::BIGINT AS cik, arg_min('T' || n_nationkey, n_nationkey) AS ticker FROM nation GROUP BY 1")
def s08(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select("n_nationkey", F.array(F.col("n_regionkey").cast("string"), "n_name", F.concat(F.lit("t"), F.col("n_nationkey").cast("string"))).alias("row"))
    data = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "row"))), lambda x: x["row"])
    doc = n.agg(data.alias("data")).select(F.to_json(F.struct(F.array(F.lit("cik"), F.lit("name"), F.lit("ticker")).alias("fields"), "data")).alias("value"))
    return src.ticker_map(doc)


def _submissions(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON document a customer, with parallel arrays; every 50th customer's arrays differ in length."""
    o = table(spark, sf, "orders")
    rows = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")))
    d = o.groupBy(F.col("o_custkey").alias("cik")).agg(rows.alias("r"))
    part = lambda f: F.transform("r", f)
    form = part(lambda x: x["o_orderstatus"])
    form = F.when(F.col("cik") % 50 == 0, F.array_append(form, F.lit("F"))).otherwise(form)
    return d.select(F.to_json(F.struct("cik", part(lambda x: x["o_orderkey"].cast("string")).alias("accession"), form.alias("form"), part(lambda x: F.to_date(x["o_orderdate"]).cast("string")).alias("filed"))).alias("value"))


@register("S11_parallel_arrays", "SELECT o_custkey AS cik, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::INTEGER AS pos, o_orderkey::VARCHAR AS accession, o_orderstatus AS form, o_orderdate::DATE AS filed FROM orders WHERE o_custkey % 50 <> 0")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    return src.submissions(_submissions(spark, sf))[0]


@register("S13_latest_submission", "SELECT o_custkey AS cik, arg_min(o_orderkey, (o_orderdate, o_orderkey))::VARCHAR AS accession FROM orders WHERE o_custkey % 50 <> 0 AND o_orderstatus IN ('F', 'P') GROUP BY 1")
def s13(spark: SparkSession, sf: str) -> DataFrame:
    return src.latest_submission(src.submissions(_submissions(spark, sf))[0], ("F", "P"))


@register("S14_only_accession", "SELECT k::VARCHAR AS accession, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS status FROM (SELECT o_orderkey AS k FROM orders UNION ALL SELECT -o_orderkey FROM orders WHERE o_orderstatus = 'P') LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = k")
def s14(spark: SparkSession, sf: str) -> DataFrame:
    """Every order's key is asked for, and some keys that no filing has."""
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("accession"))
    o = table(spark, sf, "orders")
    asked = o.select("o_orderkey").unionByName(o.where("o_orderstatus = 'P'").select((-F.col("o_orderkey")).alias("o_orderkey")))
    return src.only_accession(f, asked.select(F.col("o_orderkey").cast("string").alias("accession")))


@register("S12_company_facts", "SELECT o_custkey % 100 AS cik, 'core' AS taxonomy, o_orderstatus AS tag, 'USD' AS unit, o_orderdate::DATE AS period_end, round(o_totalprice)::BIGINT AS val, o_orderkey::VARCHAR AS accn FROM orders WHERE o_orderkey % 13 <> 0")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    fact = F.struct(F.to_date("o_orderdate").cast("string").alias("end"), F.when(F.col("o_orderkey") % 13 != 0, F.round("o_totalprice").cast("bigint")).alias("val"), F.col("o_orderkey").cast("string").alias("accn"))
    units = o.groupBy((F.col("o_custkey") % 100).alias("cik"), "o_orderstatus").agg(F.struct(F.lit("x").alias("label"), F.create_map(F.lit("USD"), F.collect_list(fact)).alias("units")).alias("c"))
    docs = units.groupBy("cik").agg(F.create_map(F.lit("core"), F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "c")))).alias("facts"))
    return src.company_facts(docs.select(F.to_json(F.struct("cik", "facts")).alias("value")))


@register("S15_ownership_xml", "SELECT l_orderkey AS issuer, l_returnflag AS code, l_quantity::BIGINT AS shares FROM lineitem WHERE l_orderkey % 10 <> 0")
def s15(spark: SparkSession, sf: str) -> DataFrame:
    one = F.concat(F.lit("<transaction><code>"), "l_returnflag", F.lit("</code><shares>"), F.col("l_quantity").cast("bigint").cast("string"), F.lit("</shares></transaction>"))
    head = F.when(F.col("l_orderkey") % 10 == 0, "<!DOCTYPE x>").otherwise("")
    docs = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(one), "").alias("t"))
    return src.ownership_xml(docs.select(F.concat(head, F.lit("<doc><issuer>"), F.col("l_orderkey").cast("string"), F.lit("</issuer>"), "t", F.lit("</doc>")).alias("value")))


@register("S16_licensed_gate", "SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'not_authorized' WHEN DATE '2024-01-01' + (doc_id % 400)::INTEGER < DATE '2024-06-01' THEN 'expired' WHEN lang NOT IN ('en', 'fr') THEN 'language' ELSE 'admitted' END AS gate FROM documents")
def s16(spark: SparkSession, sf: str) -> DataFrame:
    mode = F.when(F.col("doc_id") % 7 == 0, "trial").otherwise("authorized")
    rights = F.struct(mode.alias("mode"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")).cast("string").alias("expires_on"))
    return src.licensed(table(spark, sf, "documents").select(F.to_json(F.struct(F.col("doc_id").alias("id"), rights.alias("rights"), F.col("lang").alias("language"))).alias("value")), "2024-06-01")


@register("S17_checksum", "SELECT o_orderkey, ('1015' || lpad(o_orderkey::VARCHAR, 16, '0') || lpad(((o_orderkey * 7) % 98)::VARCHAR, 2, '0'))::HUGEINT % 97 = 1 AS valid FROM orders")
def s17(spark: SparkSession, sf: str) -> DataFrame:
    code = F.concat(F.lit("AF"), F.lpad(F.col("o_orderkey").cast("string"), 16, "0"), F.lpad(((F.col("o_orderkey") * 7) % 98).cast("string"), 2, "0"))
    return table(spark, sf, "orders").select("o_orderkey", lei_valid(code).alias("valid"))


_VISIBLE = "html"
_VISIBLE = rf"regexp_replace({_VISIBLE}, '(?s)<!--.*?-->', ' ', 'g')"
for _tag in tx.HIDDEN:
    _VISIBLE = rf"regexp_replace({_VISIBLE}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}>', ' ', 'g')"
_VISIBLE = rf"regexp_replace({_VISIBLE}, '(?s)<[^>]*>', ' ', 'g')"
for _name, _char in tx.ENTITIES.items():
    _VISIBLE = f"replace({_VISIBLE}, '{_name}', '{_char.replace(chr(39), chr(39) * 2)}')"
_VISIBLE = rf"trim(regexp_replace({_VISIBLE}, '[ \t\n\r\f]+', ' ', 'g'))"


@register("X01_visible_text", f"SELECT page_id, {_VISIBLE} AS body FROM pages")
def x01(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.visible_text(F.col("html")).alias("body"))


@register("X02_heading_sections", "SELECT page_id, (i - 1)::INTEGER AS pos, h FROM (SELECT page_id, generate_subscripts(hs, 1) AS i, unnest(hs) AS h FROM (SELECT page_id, list_slice(regexp_extract_all(html, '(?is)<h[1-3][^>]*>.*?</h[1-3]>'), 1, 64) AS hs FROM pages))")
def x02(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.posexplode(F.slice(tx.headings(F.col("html")), 1, 64)).alias("pos", "h"))


@register("X03_normalize", r"SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')))) AS digest FROM documents")
def x03(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(tx.fold(F.col("text")), 256).alias("digest"))


_TERMS = ("the", "license", "token", "der", "les", "phone")


@register("X04_term_hits", "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower(text), '{t}') THEN '{t}' END" for t in _TERMS) + ") AS hits FROM documents")
def x04(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(tx.term_hits(F.col("text"), _TERMS), ",").alias("hits"))


@register("X06_without_quotes", "SELECT doc_id, length(replace(replace(text, 'the', ' '), 'and', ' ')) AS n FROM documents")
def x06(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.length(tx.without_quotes(F.col("text"), F.array(F.lit("the"), F.lit("and")))).cast("bigint").alias("n"))


@register("X07_token_estimate", "SELECT lang, sum((length(text) + 3) // 4)::BIGINT AS tokens FROM documents GROUP BY 1")
def x07(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang").agg(F.sum(tx.token_estimate(F.col("text"))).alias("tokens"))


@register("X11_only_match", "SELECT doc_id, CASE WHEN len(list_distinct(regexp_extract_all(text, '[0-9]{4,6}'))) = 1 THEN regexp_extract(text, '[0-9]{4,6}') END AS only FROM documents")
def x11(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.only_match(F.regexp_extract_all("text", F.lit("[0-9]{4,6}"), 0)).alias("only"))


@register("X12_literal_signals", r"SELECT doc_id, regexp_matches(text, '(?i)all rights reserved') AS rights, regexp_matches(text, '(?i)licensed under') AS licensed, regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+') AS mail FROM documents")
def x12(spark: SparkSession, sf: str) -> DataFrame:
    signals = {"rights": "(?i)all rights reserved", "licensed": "(?i)licensed under", "mail": "[a-z0-9.]+@[a-z0-9.]+"}
    return table(spark, sf, "documents").select("doc_id", *[F.col("text").rlike(p).alias(n) for n, p in signals.items()])


@register("X15_name_key", "SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS name_key FROM customer")
def x15(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", tx.name_key(F.col("c_name")).alias("name_key"))


@register("X19_tag_extraction", "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a href='))::INTEGER AS links FROM pages")
def x19(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<a href="), 0)).alias("links"))


@register("X20_canonical_url", "SELECT page_id, regexp_replace(regexp_replace(lower(p), ':80$', '') || substr(b, length(p) + 1), '/+$', '') AS url FROM (SELECT page_id, b, regexp_extract(b, '^([a-zA-Z]+://[^/]*)', 1) AS p FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS b FROM pages))")
def x20(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("url"))


@register("X22_padded_codes", "SELECT c_custkey, lpad(c_custkey::VARCHAR, 10, '0') AS cik, upper(trim(' ' || c_mktsegment || ' ')) AS segment FROM customer")
def x22(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"), F.upper(F.trim(F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")))).alias("segment"))


@register("X23_whole_number_match")
def x23(spark: SparkSession, sf: str) -> DataFrame:
    """Guards around the number are look-arounds, which the other engine's patterns lack."""
    return table(spark, sf, "documents").select("doc_id", tx.holds_number(F.col("text"), "3").alias("holds_three"))


_ALLOWED = ("cik", "hypothesis", "ticker", "urls")


@register("X25_submissions", r"WITH c AS (SELECT *, upper(role) AS ticker, lpad(conv_id::VARCHAR, 10, '0') AS cik, lower(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'))) AS idea, list_sort(list_distinct(['https://a.b/' || (turn % 3), 'https://a.b/' || (conv_id % 3)])) AS urls FROM conversations) SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN 'unknown_field' WHEN idea = '' THEN 'empty_hypothesis' ELSE 'accepted' END AS status, CASE WHEN conv_id % 7 <> 0 AND idea <> '' THEN sha256(concat_ws(chr(10), ticker, cik, idea, array_to_string(urls, chr(10)))) END AS dedupe_key FROM c")
def x25(spark: SparkSession, sf: str) -> DataFrame:
    """Submissions as JSON: a field that is not allowed rejects one; the key covers the whole hypothesis and the set of links."""
    link = lambda c: F.concat(F.lit("https://a.b/"), (F.col(c) % 3).cast("string"))
    fields = [F.upper("role").alias("ticker"), F.col("conv_id").cast("string").alias("cik"), F.col("text").alias("hypothesis"), F.array(link("turn"), link("conv_id")).alias("urls")]
    extra = F.when(F.col("conv_id") % 7 == 0, F.to_json(F.struct(*fields, F.lit("x").alias("note")))).otherwise(F.to_json(F.struct(*fields)))
    return tx.submissions(table(spark, sf, "conversations").select("conv_id", "turn", extra.alias("value")), "value", _ALLOWED).select("conv_id", "turn", "status", "dedupe_key")


@register("D01_section_diff", r"WITH s AS (SELECT conv_id, turn // 2 AS section, turn % 2 AS version, lower(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'))) AS x FROM conversations WHERE role <> 'system') SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.section, b.section) AS section, CASE WHEN a.x IS NULL THEN 'added' WHEN b.x IS NULL THEN 'removed' ELSE 'modified' END AS change FROM (SELECT * FROM s WHERE version = 0) a FULL JOIN (SELECT * FROM s WHERE version = 1) b ON a.conv_id = b.conv_id AND a.section = b.section WHERE a.x IS DISTINCT FROM b.x")
def d01(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "conversations").where("role <> 'system'").select("conv_id", F.expr("turn div 2").alias("section"), (F.col("turn") % 2).alias("version"), "text")
    return ch.section_changes(s.where("version = 0"), s.where("version = 1"), ["conv_id", "section"]).select("conv_id", "section", "change")


_EVENTS = "e AS (SELECT event_id, user_id AS issuer, event_type AS category, ts AS seen_at, md5(event_type || (event_id % 7)) AS fingerprint, value AS amount FROM events)"


def _disclosures(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("issuer"), F.col("event_type").alias("category"), F.col("ts").alias("seen_at"), F.md5(F.concat("event_type", (F.col("event_id") % 7).cast("string"))).alias("fingerprint"), F.col("value").alias("amount"))


@register("D06_prior_events", f"WITH {_EVENTS} SELECT issuer, count(*) AS n, min(seen_at) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY seen_at DESC, event_id DESC) AS r FROM e) WHERE r <= 64 GROUP BY 1")
def d06(spark: SparkSession, sf: str) -> DataFrame:
    return ch.recent(_disclosures(spark, sf), ["issuer"], 64).groupBy("issuer").agg(F.count("*").alias("n"), F.min("seen_at").alias("oldest"))


@register("D07_manifest", "SELECT conv_id, count(*) AS n_sections, sha256(string_agg(turn::VARCHAR || ':' || sha256(text), chr(10) ORDER BY turn)) AS manifest FROM conversations GROUP BY 1")
def d07(spark: SparkSession, sf: str) -> DataFrame:
    return ch.manifest(table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("selector"), "text"), ["conv_id"])


@register("J15_prior_exact_preferred", f"WITH {_EVENTS}, p AS (SELECT a.event_id, b.event_id AS prior, row_number() OVER (PARTITION BY a.event_id ORDER BY (b.fingerprint = a.fingerprint) DESC, b.seen_at DESC, b.event_id DESC) AS r FROM e a JOIN e b ON a.issuer = b.issuer AND a.category = b.category AND b.seen_at < a.seen_at) SELECT event_id, prior FROM p WHERE r = 1")
def j15(spark: SparkSession, sf: str) -> DataFrame:
    """The last earlier event with the same fingerprint, else the last earlier one: two ordered windows."""
    e = _disclosures(spark, sf)
    exact = Window.partitionBy("issuer", "category", "fingerprint").orderBy("seen_at", "event_id")
    every = Window.partitionBy("issuer", "category").orderBy("seen_at", "event_id")
    out = e.select("event_id", F.coalesce(F.lag("event_id").over(exact), F.lag("event_id").over(every)).alias("prior"))
    return out.where("prior is not null")


@register("S01_csv_bars", f"WITH {BARS} SELECT instrument_id, session_date, close, volume FROM bars WHERE instrument_id % 7 <> 3 AND NOT (volume % 50 = 0)")
def s01(spark: SparkSession, sf: str) -> DataFrame:
    """One CSV file an instrument: some with another header, some with their columns in another order, some lines broken."""
    from pyspark.sql import Window

    names = ["instrument_id", "session_date", "open", "high", "low", "close", "volume"]
    b = bars(spark, sf)
    line = F.row_number().over(Window.partitionBy("instrument_id").orderBy("session_date"))
    cell = lambda n: F.when((F.col("volume") % 50 == 0) & F.lit(n == "high"), "n/a").otherwise(F.col(n).cast("string"))
    said = F.when(F.col("instrument_id") % 2 == 0, F.concat_ws(",", *[cell(n) for n in names])).otherwise(F.concat_ws(",", *[cell(n) for n in names[::-1]]))
    rows = b.select(F.col("instrument_id").alias("file"), line.alias("line"), said.alias("value"))
    head = F.when(F.col("file") % 7 == 3, ",".join([*names, "note"])).when(F.col("file") % 2 == 0, ",".join(names)).otherwise(",".join(names[::-1]))
    heads = b.select(F.col("instrument_id").alias("file")).distinct().select("file", F.lit(0).alias("line"), head.alias("value"))
    return src.csv_bars(rows.unionByName(heads)).select("instrument_id", "session_date", "close", "volume")


@register("S18_historical_dataset", "SELECT o_custkey::VARCHAR AS dataset, o_orderkey::VARCHAR AS case_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS label, CASE WHEN o_orderkey % 7 <> 0 THEN ((o_orderkey % 200 - 100) / 1000.0)::DECIMAL(18,4) END AS asset_return, CASE WHEN o_orderkey % 5 = 0 THEN 'no_prediction' WHEN o_orderkey % 7 = 0 THEN 'no_outcome' ELSE 'complete' END AS status FROM orders WHERE o_custkey % 10 <> 0")
def s18(spark: SparkSession, sf: str) -> DataFrame:
    """A dataset a customer, its orders as cases; every tenth states another number of cases and is refused."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    case = k.cast("string").alias("case_id")
    predicted = F.when(k % 5 != 0, F.struct(case, F.col("o_orderpriority").alias("label"), F.lit(30).alias("horizon_days")))
    outcome = F.when(k % 7 != 0, F.struct(case, ((k % 200 - 100) / 1000).cast("decimal(18,4)").alias("asset_return")))
    d = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.collect_list(F.struct(case)).alias("universe"), F.collect_list(predicted).alias("predictions"), F.collect_list(outcome).alias("outcomes"))
    stated = F.when(F.col("o_custkey") % 10 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("expected_universe_count")
    docs = d.select(F.to_json(F.struct(F.col("o_custkey").cast("string").alias("dataset_name"), stated, "universe", "predictions", "outcomes")).alias("value"))
    return src.historical_cases(docs).select("dataset", "case_id", "label", "asset_return", "status")
