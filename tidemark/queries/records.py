"""Text, records and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.queries import fixtures as fx
from tidemark.queries.fixtures import r6, s6, with_
from tidemark.registry import Registry
from tidemark.sources import series as src
from tidemark.sources import sinks
from tidemark.storage import fresh_path

reg = Registry()
Q = reg.query


@Q("SELECT u AS url, CASE WHEN d <> '' THEN substr(d, 1, 4) || '-' || substr(d, 5, 2) || '-' || substr(d, 7, 2) ELSE '' END AS date FROM (SELECT u, regexp_extract(u, '\\d{8}', 0) AS d FROM (SELECT url AS u FROM pages UNION ALL VALUES ('https://x.example/minutes20190130.htm'), ('/a/20240131b.htm')))")
def date_from_url(spark, sf):
    u = fx.table(spark, sf, "pages").select("url").union(spark.createDataFrame([("https://x.example/minutes20190130.htm",), ("/a/20240131b.htm",)], "url string"))
    return u.select("url", tx.date_from_url(F.col("url")).alias("date"))


_CLEAN = "regexp_replace(regexp_replace(regexp_replace({x}, '\\n{{3,}}', '\n\n', 'g'), ' {{2,}}', ' ', 'g'), '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"


@Q("SELECT doc_id, " + _CLEAN.format(x="text") + " AS text FROM documents UNION ALL SELECT -1, " + _CLEAN.format(x="'  a   b\n\n\n\nc  '"))
def clean_text(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "text")
    d = d.union(spark.createDataFrame([(-1, "  a   b\n\n\n\nc  ")], "doc_id bigint, text string"))
    return d.select("doc_id", tx.clean_text(F.col("text")).alias("text"))


_PAGES = [
    (1, '<div class="article__time">June 1, 2020</div>'),
    (2, '<p>x</p><time datetime="2021-03-04">4 March</time>'),
    (3, '<span class="pubdate"> May 5 </span><time datetime="2000-01-01">'),
]


@Q("SELECT page_id, '' AS date FROM pages UNION ALL VALUES (-1, 'June 1, 2020'), (-2, '2021-03-04'), (-3, 'May 5')")
def date_from_page(spark, sf):
    p = fx.table(spark, sf, "pages").select("page_id", "html")
    p = p.union(spark.createDataFrame([(-i, h) for i, h in _PAGES], "page_id bigint, html string"))
    return p.select("page_id", tx.date_from_page(F.col("html")).alias("date"))


_TITLE = "trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'))"
_BODY = "substr(" + _CLEAN.format(x="regexp_replace(regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', '\n', 'g')") + ", 1, 50000)"


@Q(f"SELECT page_id, {_TITLE} AS title, {_BODY} AS body FROM pages")
def html_body_text(spark, sf):
    p = fx.table(spark, sf, "pages")
    return p.select("page_id", tx.html_title(F.col("html")).alias("title"), tx.html_body_text(F.col("html")).alias("body"))


@Q("SELECT page_id, url, " + _TITLE + " AS title, len(regexp_extract_all(html, '(?i)href=\"([^\"]*)\"', 1))::INT AS n_links FROM pages")
def scan_web(spark, sf):
    p = fx.table(spark, sf, "pages")
    return p.select("page_id", "url", tx.html_title(F.col("html")).alias("title"), F.size(tx.links(F.col("html"))).alias("n_links"))


@Q("SELECT page_id, array_to_string(list_transform((list_filter(regexp_extract_all(html, '(?i)href=\"([^\"]*)\"', 1), lambda u: contains(u, 'th') AND ends_with(u, '.')))[1:5], lambda u: CASE WHEN starts_with(u, '/') THEN 'https://x.example' || u ELSE u END), ' ') AS links FROM pages")
def link_filter(spark, sf):
    p = fx.table(spark, sf, "pages")
    return p.select("page_id", F.array_join(tx.link_filter(F.col("html"), "th", ".", 5, "https://x.example/"), " ").alias("links"))


_REPORT = "## Summary\nGrowth slows.\n- one\n* two\n• three\n\n**Regime Assessment:** The data corroborate it.\nMore.\n# Risks\n- credit\n"
_REPORT_SQL = _REPORT.replace("'", "''")


@Q(f"SELECT conv_id, turn, trim(regexp_replace(regexp_extract(r, '(?is)(?:\\*\\*Regime Assessment:?\\*\\*:?|#+[ ]*Regime Assessment:?)[ ]*\n?(.*?)(?:\n\\*\\*|\n#|\\z)', 1), '^[\\s]+|[\\s]+$', '', 'g')) AS section FROM (SELECT conv_id, turn, '{_REPORT_SQL}' || text AS r FROM conversations)")
def section_extract(spark, sf):
    c = fx.table(spark, sf, "conversations").withColumn("r", F.concat(F.lit(_REPORT), "text"))
    return c.select("conv_id", "turn", tx.section_extract(F.col("r"), "Regime Assessment").alias("section"))


@Q("SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, '\n'), lambda s: regexp_replace(s, '^[ \\t\\r•*-]+|[ \\t\\r]+$', '', 'g')), lambda s: s <> ''), '|') AS bullets FROM conversations")
def bullets(spark, sf):
    c = fx.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.array_join(tx.bullets(F.col("text")), "|").alias("bullets"))


@Q("SELECT doc_id, CASE WHEN contains(lower(t), 'corroborat') THEN 'corroborates' WHEN contains(lower(t), 'contradict') THEN 'contradicts' ELSE 'neutral' END AS alignment FROM (SELECT doc_id, text AS t FROM documents UNION ALL VALUES (-1, 'They Corroborate.'), (-2, 'contradicts it'))")
def alignment_score(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", F.col("text").alias("t"))
    d = d.union(spark.createDataFrame([(-1, "They Corroborate."), (-2, "contradicts it")], "doc_id bigint, t string"))
    return d.select("doc_id", tx.alignment_score(F.col("t")).alias("alignment"))


@Q("SELECT lang, 'Regime: recession (p=0.731)\nFactors: credit=-0.50, real=1.25\n---\n' || array_to_string(list_transform(list(text ORDER BY doc_id)[1:3], lambda t: substr(t, 1, 1500)), '\n---\n') AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3 GROUP BY lang")
def prompt_render(spark, sf):
    from pyspark.sql import Window

    top = fx.table(spark, sf, "documents").withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).filter("rn <= 3")
    got = top.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda s: s["text"]).alias("texts"))
    factors = F.create_map(F.lit("real"), F.lit(1.25), F.lit("credit"), F.lit(-0.5))
    return got.select("lang", tx.prompt_render(F.lit("recession"), F.lit(0.7312), factors, F.col("texts")).alias("prompt"))


@Q("SELECT code, 'Regime ' || code || ' with probability 12.5%. No narrative model is configured.' AS report FROM (VALUES ('recession'), ('expansion')) v(code)")
def placeholder_report(spark, sf):
    r = spark.createDataFrame([("recession",), ("expansion",)], "code string")
    return r.select("code", tx.placeholder_report(F.col("code"), F.lit(0.125)).alias("report"))


_HEAD = with_(fx.MONTHLY)


@Q(_HEAD + "SELECT code, '{\"code\":\"' || code || '\",\"months\":' || count(*) || ',\"first\":\"' || min(month_end) || '\"}' AS json FROM monthly GROUP BY code")
def json_result(spark, sf):
    m = fx.monthly(spark, sf).groupBy("code").agg(F.count("*").alias("months"), F.min("month_end").alias("first"))
    return m.select("code", sinks.as_json("code", "months", "first").alias("json"))


@Q(_HEAD + "SELECT code, code || ': ' || count(value) || ' of ' || count(*) || ' months' AS summary FROM monthly GROUP BY code")
def sink_json_result(spark, sf):
    m = fx.monthly(spark, sf).groupBy("code").agg(F.count("value").alias("k"), F.count("*").alias("n"))
    return m.select("code", F.format_string("%s: %d of %d months", "code", "k", "n").alias("summary"))


@Q(_HEAD + "SELECT '{\"first\":\"' || min(month_end) || '\",\"weights\":{\"probit\":0.5,\"cfnai\":0.5},\"codes\":' || count(DISTINCT code) || '}' AS json FROM monthly")
def live_summary(spark, sf):
    w = F.create_map(F.lit("probit"), F.lit(0.5), F.lit("cfnai"), F.lit(0.5))
    m = fx.monthly(spark, sf).agg(F.min("month_end").alias("first"), F.countDistinct("code").alias("codes"))
    return m.select(sinks.as_json("first", w.alias("weights"), "codes").alias("json"))


# --- sinks: written to the shared folder and read back --------------------
def _wide(spark, sf):
    codes = [c for c, *_ in fx.CATALOGUE]
    return fx.monthly(spark, sf).groupBy("month_end").pivot("code", codes).agg(F.first("value")), codes


def _saved(spark, sf):
    wide, codes = _wide(spark, sf)
    path = fresh_path(spark, "vintages")
    # Three vintages are cut from the panel, so it is made once.
    wide.write.parquet(f"{path}-panel")
    wide = spark.read.parquet(f"{path}-panel")
    for vintage in ("2001-06-30", "2001-09-30", "2001-09-30"):
        sinks.save_vintage(wide.filter(F.col("month_end") <= F.lit(vintage).cast("date")), path, vintage)
    return path, codes


_ALL = "grid AS (SELECT month_end, code FROM (SELECT DISTINCT month_end FROM monthly), (SELECT DISTINCT code FROM monthly)), long AS (SELECT month_end, code, value FROM grid LEFT JOIN monthly USING (month_end, code))"


@Q(with_(fx.MONTHLY, _ALL) + f"SELECT month_end, code, {s6('value', 2)} AS value, v AS vintage_date FROM long, (VALUES ('2001-06-30'), ('2001-09-30')) x(v) WHERE month_end <= v::DATE")
def sink_vintage(spark, sf):
    """A vintage saved twice is there once."""
    path, _ = _saved(spark, sf)
    return sinks.vintages(spark, path).select("month_end", "code", r6("value", 2).alias("value"), "vintage_date")


@Q(with_(fx.MONTHLY) + f"SELECT month_end, {s6(chr(109) + 'ax(value) FILTER (code = ' + chr(39) + '1-URGENT' + chr(39) + ')', 2)} AS urgent, {s6('max(value) FILTER (code = ' + chr(39) + '5-LOW' + chr(39) + ')', 2)} AS low FROM monthly WHERE month_end <= DATE '2001-06-30' GROUP BY month_end")
def load_vintage(spark, sf):
    path, codes = _saved(spark, sf)
    w = sinks.load_vintage(spark, path, "2001-06-30", codes)
    return w.select("month_end", r6(F.col("`1-URGENT`"), 2).alias("urgent"), r6(F.col("`5-LOW`"), 2).alias("low"))


@Q("SELECT * FROM (VALUES ('2001-06-30'), ('2001-09-30')) v(vintage_date)")
def list_vintages(spark, sf):
    path, _ = _saved(spark, sf)
    return sinks.list_vintages(spark, path)


@Q(with_(fx.MONTHLY) + f"SELECT month_end AS as_of, month_end + 60 AS knowable_at, {s6('avg(value)')} AS level FROM monthly GROUP BY month_end")
def sink_features(spark, sf):
    """Written in two runs; the second adds only dates that are not there."""
    rows = fx.monthly(spark, sf).groupBy(F.col("month_end").alias("as_of")).agg(r6(F.avg("value")).alias("level"))
    rows = rows.withColumn("knowable_at", F.date_add("as_of", 60))
    path = fresh_path(spark, "features")
    sinks.append_features(rows.filter("as_of < DATE '1998-01-01'"), path)
    return sinks.append_features(rows, path).select(F.col("as_of").cast("date").alias("as_of"), "knowable_at", "level")


@Q(with_(fx.MONTHLY) + f"SELECT code, month_end, {s6('value', 2)} AS value FROM monthly")
def sink_history(spark, sf):
    path = fresh_path(spark, "history")
    fx.monthly(spark, sf).select("code", "month_end", r6("value", 2).alias("value")).write.csv(path, header=True)
    return src.read_panel_csv(spark, path, "code string, month_end date, value double")


@Q(with_(fx.MONTHLY) + f"SELECT month_end, {s6('sum(value)', 2)} AS total FROM monthly GROUP BY month_end")
def scan_csv_panel(spark, sf):
    path = fresh_path(spark, "panel")
    fx.monthly(spark, sf).groupBy("month_end").agg(r6(F.sum("value"), 2).alias("total")).write.csv(path, header=True)
    return src.read_panel_csv(spark, path, "month_end date, total double")


@Q(with_(fx.MONTHLY) + "SELECT code, count(*) AS months FROM monthly GROUP BY code")
def sink_hub(spark, sf):
    path = fresh_path(spark, "hub")
    fx.monthly(spark, sf).groupBy("code").agg(F.count("*").alias("months")).write.json(path)
    return spark.read.schema("code string, months bigint").json(path)
