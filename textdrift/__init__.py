"""textdrift: measure how texts drift when they are rewritten again and again, on Spark.

Layout
------
- ``sources``    reading and writing version tables, chain tables and metric tables (S1-S6),
                 plus the fixture views built from the driver tables.
- ``functions``  column expressions: stage/paraphraser/family, cleaning, tokenizers, vector math,
                 and the one Arrow UDF (LCS length).
- ``operators``  DataFrame -> DataFrame operators: reshape (R), similarity (M), style (Y),
                 entities (E), counts (C), learning (L), audit (A).
- ``plans``      the registered queries and their DuckDB oracle SQL.
- ``streaming``  the per-version derivations applied to a file stream of incoming versions.
"""

__version__ = "0.1.0"
