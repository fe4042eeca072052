"""Page-level predicates as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import constants as K


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def visible_text(html: Column) -> Column:
    """Text without tags, scripts and styles; for flags, where the parser's exactness isn't needed."""
    plain = F.regexp_replace(html, r"(?is)<(script|style|template|noscript)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?s)<[^>]*>", " "), r"\s+", " "))


def soft_404(title_: Column, text: Column, html: Column) -> Column:
    """H16."""
    low = F.lower(text)
    phrase = reduce(lambda a, b: a | b, (low.contains(p) for p in K.SOFT_404_PHRASES))
    next_page = html.rlike(r"""id=["']?__NEXT_DATA__""") & html.rlike(r'"page"\s*:\s*"/404')
    found = title_.rlike(K.SOFT_404_STRONG) | next_page | html.rlike(r"""id=["']?__next_error__""") | ((F.length(text) < K.THIN_PAGE) & (title_.rlike(K.SOFT_404_WEAK) | phrase))
    return F.when(F.coalesce(html, F.lit("")) == "", F.lit(False)).otherwise(found)


def blocked_http(status: Column, html: Column) -> Column:
    """H17."""
    text = F.coalesce(html, F.lit(""))
    signature = reduce(lambda a, b: a | b, (text.contains(s) for s in K.BLOCK_SIGNATURES))
    wary = reduce(lambda a, b: a | b, (F.lower(title(text)).contains(w) for w in K.BLOCK_TITLES))
    return F.coalesce(status.isin(403, 429, 503), F.lit(False)) | signature | (wary & (F.regexp_count(text, F.lit(r"(?i)<a[\s>]")) < 3))


def blocked_browser(html: Column) -> Column:
    """H18."""
    text = F.coalesce(html, F.lit(""))
    return (text.contains("Just a moment...") & text.contains("Cloudflare")) | text.contains("Attention Required! | Cloudflare") | text.contains("cf-browser-verification") | (text.contains("403 Forbidden") & F.lower(text).contains("cloudflare"))


def dump_name(url: Column) -> Column:
    """A file name for a page's raw HTML."""
    netloc = F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1)
    path = F.btrim(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), F.lit("/"))
    stem = F.concat(netloc, F.lit("_"), F.when(path == "", "index").otherwise(F.substring(path, 1, 30)))
    return F.concat(F.regexp_replace(stem, "[^A-Za-z0-9_-]", "_"), F.lit("_"), F.substring(F.md5(url.cast("binary")), 1, 6), F.lit(".html"))


def child_key(url: Column) -> Column:
    """A key for a queued page."""
    return F.substring(F.sha2(url.cast("binary"), 256), 1, 16)
