"""DuckDB SQL fragments used by the oracle queries (plain text, no Spark)."""

from __future__ import annotations


def netloc(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


def path(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def query(u: str) -> str:
    return f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"


def fragment(u: str) -> str:
    return f"regexp_extract({u}, '^[^#]*#(.*)$', 1)"


def url_key(u: str) -> str:
    """scheme://netloc+path of an absolute URL."""
    return f"regexp_extract({u}, '^([^?#]*)', 1)"


def origin(u: str) -> str:
    return f"regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"


def site_key(u: str) -> str:
    return f"replace({netloc(u)}, 'www.', '')"


def unescape(x: str) -> str:
    """The named entities that occur in the driver pages, '&amp;' last."""
    out = x
    for ent, ch in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&copy;", "\u00a9"),
                    ("&middot;", "\u00b7"), ("&nbsp;", "\u00a0")):
        out = f"replace({out}, '{ent}', '{ch}')"
    return f"replace({out}, '&amp;', '&')"


def anchors_cte(src: str = "fx_pages") -> str:
    """Every <a href="…">text</a> with its position (the driver pages use exactly this form)."""
    pat = '<a href="([^"]*)">([^<]*)</a>'
    return f"""
a_raw AS (
  SELECT page_id, url AS src_url,
         regexp_extract_all(html, '{pat}', 1) AS hrefs,
         regexp_extract_all(html, '{pat}', 2) AS texts
  FROM {src}),
a_rows AS (
  SELECT page_id, src_url, unnest(range(len(hrefs))) AS pos, unnest(hrefs) AS raw_href, unnest(texts) AS raw_text
  FROM a_raw),
links AS (
  SELECT page_id, src_url, CAST(pos AS INTEGER) AS pos, href,
         CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
              ELSE {origin('src_url')} || href END AS url,
         CASE WHEN t = '' THEN '(No text)' ELSE left(t, 100) END AS text
  FROM (SELECT *, replace(raw_href, '&amp;', '&') AS href,
               trim({unescape('raw_text')}) AS t FROM a_rows)
  WHERE href <> '' AND NOT starts_with(href, '#'))"""
