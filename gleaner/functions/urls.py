"""URL functions: plain Python for the page parser, Column expressions for plans."""

from __future__ import annotations

import functools
import os
import re
import zipfile
from urllib.parse import parse_qsl, quote_plus, unquote, urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions.udf import vectorised

LISTING, PROFILE, SITE = "directory_listing", "directory_profile", "company_site"
PROFILE_PATHS = [p for d in K.DIRECTORIES.values() for p in d["profile_paths"]]


# ---------------------------------------------------------------- plain Python


def _split(url: str):
    try:
        return urlsplit(url)
    except ValueError:
        return None


def domain_of(url: str | None) -> str:
    """Lower-case host without port, brackets or one leading www."""
    url = (url or "").strip()
    parts = _split(url if "://" in url or url.startswith("//") else f"//{url}")
    host = (parts.hostname or "") if parts else ""
    return host.lower().removeprefix("www.")


@functools.cache
def public_suffixes() -> frozenset[str]:
    """ICANN rules of the public suffix list that travels with Spark, else the system's."""
    import pyspark

    text = ""
    jars = os.path.join(os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__), "jars")
    for folder in {jars, os.path.join(os.path.dirname(pyspark.__file__), "jars")}:
        for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else ():
            if name.startswith("httpclient-4") and not text:
                with zipfile.ZipFile(os.path.join(folder, name)) as z:
                    if "mozilla/public-suffix-list.txt" in z.namelist():
                        text = z.read("mozilla/public-suffix-list.txt").decode()
    if not text and os.path.exists("/usr/share/publicsuffix/public_suffix_list.dat"):
        with open("/usr/share/publicsuffix/public_suffix_list.dat", encoding="utf-8") as f:
            text = f.read()
    text = text.split("// ===END ICANN DOMAINS===")[0]
    return frozenset(line.split()[0] for line in text.splitlines() if line.strip() and not line.startswith("//"))


def suffix_labels(host: str) -> int:
    """How many labels of a host are its public suffix; 0 if its last label isn't one."""
    rules, labels = public_suffixes(), host.lower().split(".")
    best = 0
    for i in range(len(labels)):
        tail = ".".join(labels[i:])
        size = len(labels) - i
        if f"!{tail}" in rules:
            return size - 1
        if tail in rules or (i + 1 < len(labels) and f"*.{'.'.join(labels[i + 1:])}" in rules):
            best = max(best, size)
    return best


def registered_domain(host: str | None) -> str:
    """The host's public suffix and the label before it; empty if there is none."""
    host = (host or "").strip(".").lower()
    labels, n = host.split("."), suffix_labels(host)
    return ".".join(labels[-n - 1 :]) if n and len(labels) > n else ""


def canonical_url(url: str | None) -> str:
    """One spelling for each page; empty if the URL has no usable host or port."""
    url = (url or "").strip()
    if not url:
        return ""
    parts = _split(url if "://" in url else f"https://{url.lstrip('/')}")
    host = domain_of(url)
    if parts is None or not host:
        return ""
    try:
        port = parts.port
    except ValueError:
        return ""
    scheme = parts.scheme.lower()
    place = f"[{host}]" if ":" in host else host
    if port and port != {"http": 80, "https": 443}.get(scheme):
        place += f":{port}"
    path = parts.path.rstrip("/") or "/"
    query = ""
    if not any(p in path.lower() for p in PROFILE_PATHS):
        kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not k.lower().startswith(tuple(K.IGNORED_PARAMS))]
        query = "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in kept)
    return f"{scheme}://{place}{path}" + (f"?{query}" if query else "")


def under(host: str, domain: str) -> bool:
    return host == domain or host.endswith(f".{domain}")


def page_type(url: str | None) -> str:
    host, parts = domain_of(url), _split(url if url and "://" in url else f"https://{url or ''}")
    path = parts.path.lower() if parts else ""
    for domain, profile in K.DIRECTORIES.items():
        if under(host, domain):
            return PROFILE if any(p in path for p in profile["profile_paths"]) else LISTING
    return SITE


def unwrap_redirect(url: str) -> str:
    parts = _split(url)
    for key, value in parse_qsl(parts.query) if parts else ():
        if key.lower() in K.REDIRECT_PARAMS and re.match(r"https?://", unquote(value), re.I):
            return unquote(value)
    return url


def is_external(url: str, page_domain: str) -> bool:
    host = domain_of(url)
    return bool(host) and not under(host, page_domain)


def is_social(url: str) -> bool:
    return any(under(domain_of(url), d) for d in K.SOCIAL_DOMAINS)


def site_root(url: str) -> str:
    parts = _split(url)
    return f"{parts.scheme.lower()}://{parts.netloc.lower()}/" if parts else ""


BLOCKED = re.compile("/(?:" + "|".join(map(re.escape, K.BLOCKED_PATHS)) + ")", re.I)


def blocked_path(path: str) -> bool:
    name = path.rsplit("/", 1)[-1]
    extension = name[name.rfind(".") :].lower() if "." in name.lstrip(".") else ""
    return bool(BLOCKED.search(path)) or extension in K.BLOCKED_EXTENSIONS


def resolve(base: str | None, href: str | None) -> str | None:
    try:
        return urljoin(base or "", href or "")
    except ValueError:
        return None


# ---------------------------------------------------------------- Columns

canonical_url_udf = vectorised(canonical_url, "string")
registered_domain_udf = vectorised(registered_domain, "string")
resolve_udf = vectorised(resolve, "string")


def domain(url: Column) -> Column:
    """F1 without Python: the host between the scheme (or the start) and the first of /?#, without user, port and www."""
    rest = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    authority = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@", "")
    host = F.regexp_replace(F.regexp_replace(authority, r":[0-9]*$", ""), r"[\[\]]", "")
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def path(url: Column) -> Column:
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", "")
    return F.regexp_extract(rest, r"^([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """F3 without Python, for URLs with a scheme and without escapes, ports or users; others need ``canonical_url_udf``."""
    host, p = domain(url), F.regexp_replace(path(url), r"/+$", "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.rlike("(?i)^(?:" + "|".join(K.IGNORED_PARAMS) + ")"))
    with_values = F.array_join(F.transform(kept, lambda q: F.when(q.contains("="), q).otherwise(F.concat(q, F.lit("=")))), "&")
    query = F.when(F.lower(p).rlike("|".join(PROFILE_PATHS)), "").otherwise(with_values)
    made = F.concat(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit("://"), host, F.when(p == "", "/").otherwise(p), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host == "", "").otherwise(made)


def resolved(base: Column, href: Column) -> Column:
    """F5 without Python: the absolute address of a link on the page ``base``, which has a scheme."""
    origin, plain = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(href, r"^([^?#]*)", 1)
    tail = F.substring(href, F.length(plain) + 1, F.length(href))
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, _without_dots(plain), tail))
        .when(plain == "", F.concat(origin, path(base), href))
        .otherwise(F.concat(origin, _without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), plain)), tail))
    )


def _without_dots(p: Column) -> Column:
    """A path without . and .. segments."""
    step = lambda made, x: F.when(x == ".", made).when(x == "..", F.regexp_replace(made, "/[^/]*$", "")).otherwise(F.concat(made, F.lit("/"), x))
    folded = F.aggregate(F.split(F.substring(p, F.lit(2), F.length(p)), "/"), F.lit(""), step)
    ended = F.when(p.rlike(r"/\.\.?$"), F.concat(folded, F.lit("/"))).otherwise(folded)
    return F.when(p.contains("/."), F.when(ended == "", "/").otherwise(ended)).otherwise(p)


def classify(url: Column, directories: dict | None = None) -> Column:
    """page type by a CASE over the configured directories."""
    host, p, out = domain(url), F.lower(path(url)), F.lit(None).cast("string")
    rules = []
    for d, profile in (directories or K.DIRECTORIES).items():
        here = (host == d) | host.endswith(f".{d}")
        rules.append((here, F.when(p.rlike("|".join(map(re.escape, profile["profile_paths"]))), PROFILE).otherwise(LISTING)))
    for here, kind in reversed(rules):
        out = F.when(here, kind).otherwise(out)
    return F.coalesce(out, F.lit(SITE))


def external(url: Column, page_domain: Column) -> Column:
    host = domain(url)
    return (host != "") & (host != page_domain) & ~F.endswith(host, F.concat(F.lit("."), page_domain))


def social(url: Column) -> Column:
    return domain(url).rlike(r"(^|\.)(" + "|".join(re.escape(d) for d in K.SOCIAL_DOMAINS) + ")$")


def root(url: Column) -> Column:
    return F.concat(F.lower(F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]*)", 1)), F.lit("/"))


def redirect_target(url: Column) -> Column:
    """the first redirect parameter that holds a web address, else the URL."""
    pairs = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    hits = F.filter(pairs, lambda q: F.lower(F.substring_index(q, "=", 1)).isin(K.REDIRECT_PARAMS) & F.lower(F.try_url_decode(F.regexp_extract(q, "=(.*)$", 1))).rlike("^https?://"))
    return F.coalesce(F.try_url_decode(F.regexp_extract(F.get(hits, 0), "=(.*)$", 1)), url)


def blocked(p: Column) -> Column:
    """F10 and F11 on a path."""
    return p.rlike("(?i)" + BLOCKED.pattern) | F.lower(F.regexp_extract(p, r"(\.[^./]*)$", 1)).isin(K.BLOCKED_EXTENSIONS)


def followable(href: Column) -> Column:
    """H6: a link that leads to a page."""
    return href.isNotNull() & (href != "") & ~href.rlike("^(#|javascript:|mailto:|tel:)")


def hrefs(html: Column) -> Column:
    """H5 without a DOM: the href of each anchor."""
    return F.regexp_extract_all(html, F.lit(r"""<a\s[^>]*?href=["']([^"']*)["']"""), 1)
