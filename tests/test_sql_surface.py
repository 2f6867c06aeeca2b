from urllib.parse import urljoin

from webcorpus.functions.sql import register_html_nodes, register_sql_functions


def test_sql_functions_and_html_nodes(spark):
    names = register_sql_functions(spark, "wc_")
    assert "wc_url_join" in names
    r = spark.sql("SELECT wc_url_join('https://a.com/b/c?q', '../d/./e?x#y') AS j, wc_url_key('HTTP://A.com/p?q#f') AS k, "
                  "wc_url_split('https://u@h:1/p?q#f').netloc AS n, wc_url_site('https://www.x.org/') AS s, "
                  "wc_strip_query('https://a.com/p?x=1#f') AS sq, wc_url_origin('https://a.com/p') AS o").first()
    assert r.j == urljoin("https://a.com/b/c?q", "../d/./e?x#y")
    assert (r.k, r.n, r.s, r.sq, r.o) == ("http://A.com/p", "u@h:1", "x.org", "https://a.com/p", "https://a.com")
    register_html_nodes(spark)
    rows = spark.sql("SELECT n.tag, n.text FROM VALUES ('<p>a<b>c</b></p>') AS t(h), LATERAL html_nodes(t.h) n").collect()
    assert [(x.tag, x.text) for x in rows] == [("p", None), ("#text", "a"), ("b", None), ("#text", "c")]
