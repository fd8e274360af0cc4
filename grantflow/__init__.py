"""grantflow — research-grant data harmonisation as Spark DataFrame jobs.

Subpackages:

* ``functions``  Column -> Column helpers (ids, dates, text, html, json, prompts)
* ``sources``    readers for catalogs, landed CSV / JSON / Excel / HTML files
* ``operators``  conform, validate, map, run bookkeeping, relational model, serve
* ``streaming``  incremental landing ingest with Structured Streaming
* ``plans``      the registered queries over the driver tables
"""

from grantflow.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
