"""Edges of the engine: parsers, libraries, stores and models come as callables, and Spark deals the work out.

Each callable runs in the tasks, so it must be picklable and open its own connections.  What fails is a row with its reason, never a lost row.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters a page below which a text is too thin to trust; tries of a download.
LEAST_PER_PAGE, TRIES = 200, 4
Extractor = tuple[str, Callable[[bytes], tuple[Sequence[str], int]]]


def _sparse(text: str, pages: int) -> bool:
    return pages == 0 or len(text.strip()) / pages < LEAST_PER_PAGE


def read_one(content: bytes, extractors: Sequence[Extractor], most_pages: int | None = None) -> dict:
    """Text of a file by the first extractor whose result isn't thin, else by the last that gave any; ``none`` if all failed, with their reasons."""
    text, pages, method, errors = "", 0, "none", []
    for name, extract in extractors:
        try:
            parts, count = extract(content)
        except Exception as e:  # noqa: BLE001  whatever a parser raises is the file's record
            errors.append(f"{name}: {type(e).__name__}: {e}")
            continue
        text, pages, method = "\n\n".join(list(parts)[:most_pages]), count if most_pages is None else min(count, most_pages), name
        if not _sparse(text, pages):
            break
    return {"method": method, "errors": errors, "pages": pages, "chars": len(text), "text": text, "pdf_md5": hashlib.md5(content).hexdigest()}


def extract_texts(files: DataFrame, extractors: Sequence[Extractor], most_pages: int | None = None) -> DataFrame:
    """paper_id, content -> text and how it was got; ``most_pages`` reads heads only (then without an extractor that recognises images)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([{"paper_id": p, **read_one(bytes(c), extractors, most_pages)} for p, c in zip(f["paper_id"], f["content"])], columns=["paper_id", "method", "errors", "pages", "chars", "text", "pdf_md5"])

    return files.select("paper_id", "content").mapInPandas(run, "paper_id string, method string, errors array<string>, pages int, chars int, text string, pdf_md5 string")


def to_extract(files: DataFrame, cached: DataFrame, again: bool = False) -> DataFrame:
    """Files whose cached text was made from other bytes, or isn't there."""
    if again:
        return files
    now = files.withColumn("_md5", F.md5("content"))
    return now.join(cached.select("paper_id", F.col("pdf_md5").alias("_md5")), ["paper_id", "_md5"], "left_anti").drop("_md5")


def fetch_files(wanted: DataFrame, get: Callable[[str], bytes], wait: float = 2.0) -> DataFrame:
    """paper_id, key, md5 and have_md5 (of the file there is) -> status, detail and content.

    A file that matches is not fetched again; bytes of another md5 are corrupt, bytes that are no PDF unreadable; an error is tried again, waiting twice as long each time.
    """

    def one(key: str, md5: str, have: str) -> tuple[str, str, bytes | None]:
        if md5 and md5 == have:
            return "OK", "cached", None
        for n in range(TRIES):
            try:
                body = get(key)
                break
            except Exception as e:  # noqa: BLE001
                if n + 1 == TRIES:
                    return "DOWNLOAD_FAILED", f"{type(e).__name__}: {e}", None
                time.sleep(min(30.0, wait * 2**n))
        got = hashlib.md5(body).hexdigest()
        if md5 and got != md5:
            return "DOWNLOAD_CORRUPT", f"md5 {got} instead of {md5}", None
        return ("OK", "downloaded", body) if body.startswith(b"%PDF") else ("PDF_UNREADABLE", "downloaded bytes are not a PDF", None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *one(k, m or "", h or "")) for p, k, m, h in zip(f["paper_id"], f["key"], f["md5"], f["have_md5"])]
            yield pd.DataFrame(rows, columns=["paper_id", "status", "detail", "content"])

    return wanted.select("paper_id", "key", "md5", "have_md5").mapInPandas(run, "paper_id string, status string, detail string, content binary")


def completed(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Papers that need no fetch: marked OK, with an md5, and a file that has it."""
    held = files.select("paper_id", F.col("file_md5").alias("md5"))
    return manifest.where("status = 'OK' and coalesce(md5, '') <> ''").join(held, ["paper_id", "md5"], "left_semi").select("paper_id")


# Kinds of library items that are papers, and those that only hang on one.
PAPERS, ATTACHED = ("journalArticle", "preprint", "conferencePaper"), ("note", "attachment")


def walk_library(folders: DataFrame, items: Callable[[str], Sequence[dict]], kinds: Sequence[str] = PAPERS) -> tuple[DataFrame, DataFrame]:
    """folder, nth -> (records: key with all its folders in the order of encounter; skipped: items of other kinds, with the folder they were first seen in).

    ``items`` lists a folder: dicts with key, itemType and title.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(n, i, name, x["key"], x.get("itemType") or "", x.get("title") or "") for n, name in zip(f["nth"], f["folder"]) for i, x in enumerate(items(name))]
            yield pd.DataFrame(rows, columns=["nth", "place", "folder", "key", "kind", "title"])

    found = folders.select("nth", "folder").mapInPandas(run, "nth long, place long, folder string, key string, kind string, title string").where(~F.col("kind").isin(*ATTACHED))
    first = found.where(F.col("kind").isin(*kinds)).groupBy("key", "folder").agg(F.min(F.struct("nth", "place", "title")).alias("f"))
    listed = F.array_sort(F.collect_list(F.struct("f.nth", "f.place", "folder")))
    records = first.groupBy("key").agg(F.min("f").alias("top"), F.transform(listed, lambda x: x["folder"]).alias("folders")).select("key", "top.title", "folders")
    skipped = found.where(~F.col("kind").isin(*kinds)).groupBy("key").agg(F.min(F.struct("nth", "place", "kind", "title", "folder")).alias("f")).select("key", "f.kind", "f.title", "f.folder")
    return records, skipped


def first_known(keys: DataFrame, clients: Sequence[tuple[str, Callable[[str], dict | None]]]) -> DataFrame:
    """key -> the first of several libraries that knows it, and the title there; nulls if none does."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            hits = [next(((n, x.get("title")) for n, get in clients if (x := get(k)) is not None), (None, None)) for k in f["key"]]
            yield pd.DataFrame({"key": f["key"], "library": [h[0] for h in hits], "title": [h[1] for h in hits]})

    return keys.select("key").mapInPandas(run, "key string, library string, title string")


def call_model(prompts: DataFrame, call: Callable[[str], str]) -> DataFrame:
    """paper_id, prompt -> reply, with exit_code 0 or 1 and what went wrong; the callable holds all that is known of the model."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, text in zip(f["paper_id"], f["prompt"]):
                try:
                    rows.append((p, call(text), 0, ""))
                except Exception as e:  # noqa: BLE001
                    rows.append((p, None, 1, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["paper_id", "reply", "exit_code", "detail"])

    return prompts.select("paper_id", "prompt").mapInPandas(run, "paper_id string, reply string, exit_code int, detail string")


def stored_replies(prompts: DataFrame, stored: DataFrame) -> DataFrame:
    """The same from a table of replies by paper: no model is asked."""
    j = prompts.select("paper_id").join(stored.select("paper_id", "reply"), "paper_id", "left")
    return j.select("paper_id", "reply", F.when(F.col("reply").isNull(), 1).otherwise(0).alias("exit_code"), F.when(F.col("reply").isNull(), "no stored reply").otherwise("").alias("detail"))
