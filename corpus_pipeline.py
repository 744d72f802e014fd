"""A corpus pipeline of five of the operators of weftline.llm, from ``documents`` to token digests.

Each stage takes (spark, docs, sf_dir) and works on everything that the stage before kept. All but the last return the columns
of ``documents``: doc_id, text, lang, source, n_chars.

1. quality rules: documents that fail the base counts or the likelihood-ratio threshold go;
2. line dedup: later matches of a line go, and documents that have no word left go with them;
3. SimHash near-dedup: of each group of near copies (five-word shingles, similarity 0.8) the least doc_id stays;
4. benchmark decontamination: documents with an item of the benchmark go;
5. BPE encoding and decoding: the digests of ids and decoded text of what is left.

Null or repeated rows are treated as the operators' docstrings say; empty tables pass through.
"""

from __future__ import annotations

from weftline.llm.stages import COLUMNS, STAGES, run

#: Hashes, a fitted model and merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
