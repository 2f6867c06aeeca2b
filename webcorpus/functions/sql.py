"""SQL surface: the URL functions as SQL functions (bodies are native SQL expressions, so
they run in the JVM like any built-in) and ``html_nodes`` as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import urls as U
from . import urls_sql as S


def register_sql_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """CREATE TEMPORARY FUNCTION for url_split/url_join/url_key/url_origin/url_netloc/
    url_site/strip_query; returns the registered names."""
    split_type = "STRUCT<scheme: STRING, netloc: STRING, path: STRING, query: STRING, fragment: STRING>"
    defs = {
        "url_split": ("u STRING", split_type, S.url_split("u")),
        "url_join": ("base STRING, href STRING", "STRING", S.url_join("base", "href", U.USES_RELATIVE, U.USES_NETLOC)),
        "url_key": ("u STRING", "STRING", S.url_key("u")),
        "url_origin": ("u STRING", "STRING", S.origin("u")),
        "url_netloc": ("u STRING", "STRING", S.get_domain("u")),
        "url_site": ("u STRING", "STRING", S.site_key("u")),
        "strip_query": ("u STRING", "STRING", S.strip_query("u")),
    }
    names = []
    for name, (args, ret, body) in defs.items():
        full = f"{prefix}{name}"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {full}({args}) RETURNS {ret} RETURN {body}")
        names.append(full)
    return names


def register_html_nodes(spark: SparkSession, name: str = "html_nodes") -> str:
    """``SELECT … FROM pages, LATERAL html_nodes(html)``: the H1 tree as rows (Python UDTF;
    prefer ``operators.html.parse_pages`` in DataFrame code, which keeps nodes as an array)."""
    from pyspark.sql.functions import udtf

    from ..operators.html import parse_html

    @udtf(returnType="idx int, parent int, `end` int, depth int, tag string, attrs map<string,string>, "
                     "classes array<string>, text string")
    class HtmlNodes:
        def eval(self, html):
            for n in parse_html(html) or []:
                yield (n["idx"], n["parent"], n["end"], n["depth"], n["tag"], n["attrs"], n["classes"], n["text"])

    spark.udtf.register(name, HtmlNodes)
    return name
