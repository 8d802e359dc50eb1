"""Text functions over pages, documents and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHARS = 50_000


def date_from_url(url: Column) -> Column:
    """The first eight digits in a row as YYYY-MM-DD, else empty."""
    d = F.regexp_extract(url, r"(\d{4})(\d{2})(\d{2})", 0)
    return F.when(d != "", F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))).otherwise("")


def clean_text(text: Column) -> Column:
    """At most one empty line and one space in a row, trimmed of spaces and newlines."""
    lines = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(lines, r" {2,}", " "), r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def date_from_page(html: Column) -> Column:
    """Text of the first element whose class speaks of a date, else the first ``time`` element's datetime."""
    tagged = F.regexp_extract(
        html, r'(?is)<[a-z0-9]+[^>]*class="[^"]*(?:article__time|pubdate|date)[^"]*"[^>]*>([^<]*)<', 1
    )
    stamp = F.regexp_extract(html, r'(?is)<time[^>]*datetime="([^"]*)"', 1)
    return F.when(F.trim(tagged) != "", F.trim(tagged)).otherwise(stamp)


def html_title(html: Column) -> Column:
    """Text of the first h1, else h2, without tags."""
    def inner(tag: str) -> Column:
        return F.trim(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), r"<[^>]+>", ""))

    return F.when(inner("h1") != "", inner("h1")).otherwise(inner("h2"))


def html_body_text(html: Column) -> Column:
    """Visible text of the article (else the body), tags stripped, cleaned, cut to the scraper's limit."""
    article = F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1)
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)</body>", 1)
    part = F.when(article != "", article).otherwise(body)
    bare = F.regexp_replace(F.regexp_replace(part, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]+>", "\n")
    return F.substring(clean_text(bare), 1, MAX_CHARS)


def links(html: Column) -> Column:
    """All href targets in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)href="([^"]*)"'), 1)


def link_filter(html: Column, keyword: str, ending: str, first: int, base: str) -> Column:
    """The first ``first`` links that hold ``keyword`` and end in ``ending``, made absolute."""
    kept = F.filter(links(html), lambda u: u.contains(keyword) & u.endswith(ending))
    return F.transform(
        F.slice(kept, 1, first),
        lambda u: F.when(u.startswith("/"), F.concat(F.lit(base.rstrip("/")), u)).otherwise(u),
    )


def section_extract(text: Column, header: str) -> Column:
    """Text below a markdown header (bold or #) up to the next header or the end, trimmed."""
    pattern = rf"(?is)(?:\*\*{header}:?\*\*:?|#+[ ]*{header}:?)[ ]*\n?(.*?)(?:\n\*\*|\n#|\z)"
    return F.trim(F.regexp_replace(F.regexp_extract(text, pattern, 1), r"^[\s]+|[\s]+$", ""))


def bullets(text: Column) -> Column:
    """Lines without their bullet signs and surrounding space, empty ones dropped."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(s, r"^[ \t\r•*-]+|[ \t\r]+$", ""))
    return F.filter(lines, lambda s: s != "")


def alignment_score(text: Column) -> Column:
    """corroborates, contradicts or neutral, by substring."""
    low = F.lower(text)
    return F.when(low.contains("corroborat"), "corroborates").when(low.contains("contradict"), "contradicts").otherwise("neutral")


def prompt_render(label: Column, p: Column, factors: Column, texts: Column, docs: int = 3, chars: int = 1500) -> Column:
    """A prompt from a regime, its probability, a map of factors and an array of texts."""
    named = F.transform(
        F.array_sort(F.map_entries(factors)), lambda e: F.format_string("%s=%.2f", e["key"], e["value"])
    )
    shown = F.transform(F.slice(texts, 1, docs), lambda t: F.substring(t, 1, chars))
    return F.concat(
        F.format_string("Regime: %s (p=%.3f)\nFactors: ", label, p),
        F.array_join(named, ", "),
        F.lit("\n---\n"),
        F.array_join(shown, "\n---\n"),
    )


def placeholder_report(label: Column, p: Column) -> Column:
    """What stands in for a model's report where no model is reachable."""
    return F.format_string("Regime %s with probability %.1f%%. No narrative model is configured.", label, p * 100)
