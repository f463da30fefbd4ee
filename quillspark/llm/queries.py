"""The subpackage's queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

import corpus_pipeline
from quillspark.llm import ann, codes, counts, jaccard, langid, likelihood, lines, media, packing, pieces, resample, urls, warc

#: Modules of the operators, in order. A module may hold ORACLE_SQL for its query.
MODULES = (urls, packing, counts, lines, langid, pieces, media, ann, jaccard, warc, codes, resample, likelihood)


def _name(k: int, module) -> str:
    return next(x for x in vars(module) if x.startswith(f"op{k}_"))


NAMES = {_name(k, module): module for k, module in enumerate(MODULES, 1)}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in NAMES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, module in NAMES.items() if (sql := getattr(module, "ORACLE_SQL", None))}
