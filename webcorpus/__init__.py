"""webcorpus: web-corpus analytics as Spark DataFrame operators.

Every public operator is a function ``DataFrame -> DataFrame`` (or a Column
expression).  Layout:

* ``functions``  – Column expressions (URLs, filenames, Markdown text, labels)
* ``sources``    – readers, writers and the derived fixture views
* ``operators``  – HTML parsing/extraction, links, media, fetch-log analytics,
                   crawl frontier, sitemaps, Markdown rendering, link repair, reports
* ``plans``      – the registered end-to-end queries (Spark + SQL oracle)
* ``streaming``  – Structured Streaming versions of the fetch-log operators
"""

__version__ = "0.1.0"
