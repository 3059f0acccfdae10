"""The translate step: a pluggable function between de-duplication and join-back.

A translator maps a row (text and any of terms, before, after, lang, with the attempt's number) to
its translation and may raise or answer badly; ``translate`` runs a chain of them per row with retries, validates
answers, and falls back to the original text. Rows that need no translation never reach
Python: the predicate is a plain filter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestitch.functions import text as X

Translator = Callable[[dict], str]
RESULT = "translated string, status string, attempts int, error string"


class Rejected(Exception):
    """The content was refused: the result stays empty and is not tried again."""


def identity(row: dict) -> str:
    return row["text"]


def reverse_words(row: dict) -> str:
    return " ".join(reversed(row["text"].split(" ")))


def glossary_substitute(row: dict) -> str:
    """Terms ("source: target" lines) put in, longest source first."""
    pairs = [line.split(":", 1) for line in (row.get("terms") or "").split("\n") if ":" in line]
    out = row["text"]
    for source, target in sorted(pairs, key=lambda p: -len(p[0])):
        out = out.replace(source.strip(), target.strip())
    return out


def flaky(failing: float, inner: Translator = identity) -> Translator:
    """Fails for a share of texts, chosen by hash, on the first attempt only."""

    def run(row: dict) -> str:
        share = int(hashlib.md5(row["text"].encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
        if share < failing and row["attempt"] == 1:
            raise ConnectionError("busy")
        return inner(row)

    return run


def _accepted(source: str, answer: str | None) -> bool:
    return bool(answer) and not answer.startswith(X.REFUSALS)


def _one(row: dict, chain: list[Translator], retries: int) -> tuple[str, str, int, str | None]:
    attempts, error = 0, None
    for translator in chain:
        for attempt in range(1, retries + 1):
            attempts += 1
            try:
                answer = translator({**row, "attempt": attempt})
            except Rejected as e:
                return "", "rejected", attempts, str(e)
            except Exception as e:  # noqa: BLE001  any failure of a translator is a failed attempt
                error = f"{type(e).__name__}: {e}"
                continue
            answer = re.sub(r"(?s)<think>.*?</think>", "", answer or "")
            if _accepted(row["text"], answer):
                return answer, "done", attempts, None
            error = "refused"
    return row["text"], "kept", attempts, error


def translate(texts: DataFrame, chain: list[Translator], retries: int = 3) -> DataFrame:
    """The distinct rows of ``texts`` (text and any of terms, before, after, lang) with
    translated, status, attempts and error."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema) + ", " + RESULT

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [_one(r, chain, retries) for r in batch.to_dict("records")]
            yield batch.assign(**{k: [d[i] for d in done] for i, k in enumerate(("translated", "status", "attempts", "error"))})

    return texts.mapInPandas(run, schema)


def translate_segments(segments: DataFrame, chain: list[Translator], retries: int = 3, terms: DataFrame | None = None) -> DataFrame:
    """Segments with their translation. Distinct texts that need it are translated once (a text
    with its terms, where terms are given) and joined back; all others keep their text."""
    needed = segments.withColumn("need", X.needs_translation(F.col("text")))
    keys = ["text"]
    if terms is not None:
        needed = needed.join(terms, ["doc_id", "seg_idx"], "left").withColumn("terms", F.coalesce("terms", F.lit("")))
        keys = ["text", "terms"]
    done = translate(needed.where("need").select(*keys).distinct(), chain, retries)
    out = needed.join(done, keys, "left")
    return out.withColumn("translated", F.coalesce("translated", "text")).withColumn("status", F.coalesce("status", F.lit("skipped"))).drop("need")


def with_originals(segments: DataFrame, done: DataFrame) -> DataFrame:
    """doc_id, seg_idx, text: the translation of each segment, or its own text where that is
    missing or empty."""
    kept = F.coalesce(F.nullif(F.col("translated"), F.lit("")), F.col("text"))
    return segments.join(done.select("doc_id", "seg_idx", "translated"), ["doc_id", "seg_idx"], "left").select("doc_id", "seg_idx", kept.alias("text"))
