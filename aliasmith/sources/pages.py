"""Pages of a wiki dump."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import count_object

_XML = "id long, ns int, title string, redirect struct<_title:string>, revision struct<id:long,timestamp:string,text:string>"

#: By language: patterns of disambiguation pages, redirect words, category and infobox prefixes.
_DISAMBIG = [r"\{\{disambig\w*\}\}", r"\{\{airport_disambig\}\}", r"\{\{callsigndis\}\}", r"\{\{chinese title disambig\}\}", r"\{\{geodis\}\}", r"\{\{hndis(\|.*?)?\}\}", r"\{\{hospitaldis\}\}", r"\{\{mathdab\}\}", r"\{\{mountainindex\}\}", r"\{\{roaddis\}\}", r"\{\{schooldis\}\}", r"\{\{shipindex\}\}"]
LANGUAGES: dict[str, dict] = {
    "en": {"disambig": _DISAMBIG, "redirect": ["#REDIRECT", "#Redirect", "#redirect"], "stub": ["stub}}", "Wikipedia:Stub"], "category": "[[Category:", "infobox": "{{Infobox"},
    "sv": {"disambig": [r"\{\{förgrening\}\}", r"\{\{gren\w*\}\}"], "redirect": ["#OMDIRIGERING", "#REDIRECT", "#redirect"], "stub": ["stub}}"], "category": "[[Kategori:", "infobox": "{{Infobox"},
    "de": {"disambig": [r"\{\{begriffsklärung\}\}"], "redirect": ["#WEITERLEITUNG", "#REDIRECT", "#redirect"], "stub": ["stub}}"], "category": "[[Kategorie:", "infobox": "{{Infobox"},
    "cs": {"disambig": [r"\{\{rozcestník\w*\}\}"], "redirect": ["#PŘESMĚRUJ", "#REDIRECT", "#redirect"], "stub": ["pahýl}}"], "category": "[[Kategorie:", "infobox": "{{Infobox"},
    "es": {"disambig": [r"\{\{desambiguación\}\}", r"\{\{desambig\}\}"], "redirect": ["#REDIRECCIÓN", "#REDIRECT", "#redirect"], "stub": ["esbozo}}"], "category": "[[Categoría:", "infobox": "{{Ficha"},
    "ar": {"disambig": [r"\{\{توضيح\}\}"], "redirect": ["#تحويل", "#REDIRECT", "#redirect"], "stub": ["بذرة}}"], "category": "[[تصنيف:", "infobox": "{{صندوق"},
    "tr": {"disambig": [r"\{\{anlam ayrımı\}\}"], "redirect": ["#YÖNLENDİRME", "#REDIRECT", "#redirect"], "stub": ["taslak}}"], "category": "[[Kategori:", "infobox": "{{Bilgi"},
    "zh": {"disambig": [r"\{\{disambig\}\}", r"\{\{消歧义\}\}"], "redirect": ["#重定向", "#REDIRECT", "#redirect"], "stub": ["stub}}"], "category": "[[Category:", "infobox": "{{Infobox"},
}


def read_dump(spark: SparkSession, path: str, language: str = "en") -> DataFrame:
    """Parsed pages of a dump in XML, split on <page>."""
    raw = spark.read.format("xml").option("rowTag", "page").schema(_XML).load(path)
    return parse(raw.select(F.col("id").alias("page_id"), "title", "ns", F.col("revision.timestamp").alias("timestamp"), F.col("revision.text").alias("text")), language)


def _unescape(c: Column) -> Column:
    for a, b in (("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _any(c: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out |= c.startswith(p)
    return out


def parse(raw: DataFrame, language: str = "en") -> DataFrame:
    """Pages with their kind and counts. raw: page_id, title, ns, text, and timestamp (ISO, GMT) if there is one. Unknown languages are read like English."""
    by = LANGUAGES.get(language, LANGUAGES["en"])
    body = F.coalesce("text", F.lit(""))
    disambig = F.lit(False)
    for p in by["disambig"]:
        disambig |= body.rlike("(?i)" + p)
    stub = F.lit(False)
    for p in by["stub"]:
        stub |= body.contains(p)
    section = F.size(F.regexp_extract_all(body, F.lit(r"(?m)^==+[^=].*?==+\s*$"), F.lit(0)))
    when = F.try_to_timestamp(F.regexp_replace("timestamp", "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss")) if "timestamp" in raw.columns else F.lit(None).cast("timestamp")
    return raw.select(
        "page_id",
        F.trim(_unescape(F.col("title"))).alias("title"),
        "ns",
        body.alias("text"),
        _any(body, by["redirect"]).alias("is_redirect"),
        disambig.alias("is_disambig"),
        stub.alias("is_stub"),
        when.alias("revision"),
        count_object(body, by["infobox"]).alias("n_infobox"),
        count_object(body, by["category"]).alias("n_categories"),
        count_object(body, "<ref").alias("n_citations"),
        section.alias("n_sections"),
        external_links(body).alias("n_external_links"),
    )


def external_links(rendered: Column) -> Column:
    """List items between the heading of external links and the end of its list, in rendered text."""
    part = F.regexp_extract(rendered, r'(?s)id="External_links"(.*?)</ul>', 1)
    return count_object(part, "<li>")
