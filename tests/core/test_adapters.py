"""Adapters with stand-ins for parsers, libraries and models."""

import hashlib

from dossier.sources import adapters as ad


def test_extractors_fall_through(spark):
    # Callables stand inside tests: what a module defines is sent by its name, which tasks can't import.
    def thin(content):
        return ["x"], 3

    def broken(content):
        raise ValueError("no text layer")

    def good(content):
        if content == b"bad":
            raise OSError("gone")
        return ["a" * 300, "b" * 300], 2

    files = spark.createDataFrame([("p1", bytearray(b"one")), ("p2", bytearray(b"bad"))], "paper_id string, content binary")
    got = {r.paper_id: r for r in ad.extract_texts(files, [("first", broken), ("second", thin), ("third", good)]).collect()}
    assert (got["p1"].method, got["p1"].pages, got["p1"].chars, got["p1"].errors) == ("third", 2, 602, ["first: ValueError: no text layer"])
    assert (got["p2"].method, got["p2"].text, len(got["p2"].errors)) == ("second", "x", 2)
    head = ad.extract_texts(files.where("paper_id = 'p1'"), [("third", good)], most_pages=1).first()
    assert head.text == "a" * 300 and head.pages == 1
    none = ad.extract_texts(files, [("first", broken)]).first()
    assert none.method == "none" and none.pages == 0
    cached = spark.createDataFrame([("p1", hashlib.md5(b"one").hexdigest()), ("p2", "old")], "paper_id string, pdf_md5 string")
    assert [r.paper_id for r in ad.to_extract(files, cached).collect()] == ["p2"] and ad.to_extract(files, cached, again=True).count() == 2


def test_fetch(spark):
    def store(key):
        if key == "down":
            raise ConnectionError("reset")
        return {"pdf": b"%PDF-1.4 x", "html": b"<html>"}[key]

    md5 = hashlib.md5(b"%PDF-1.4 x").hexdigest()
    rows = [("a", "pdf", md5, ""), ("b", "pdf", md5, md5), ("c", "pdf", "0" * 32, ""), ("d", "html", "", ""), ("e", "down", "", ""), ("f", "pdf", None, None)]
    got = {r.paper_id: (r.status, r.detail.split(" ")[0], r.content is not None) for r in ad.fetch_files(spark.createDataFrame(rows, "paper_id string, key string, md5 string, have_md5 string"), store, wait=0.0).collect()}
    assert got == {"a": ("OK", "downloaded", True), "b": ("OK", "cached", False), "c": ("DOWNLOAD_CORRUPT", "md5", False), "d": ("PDF_UNREADABLE", "downloaded", False), "e": ("DOWNLOAD_FAILED", "ConnectionError:", False), "f": ("OK", "downloaded", True)}
    manifest = spark.createDataFrame([("a", "OK", md5), ("b", "OK", "x"), ("c", "OK", None), ("d", "PDF_MISSING", md5)], "paper_id string, status string, md5 string")
    files = spark.createDataFrame([(p, md5) for p in "abcd"], "paper_id string, file_md5 string")
    assert [r.paper_id for r in ad.completed(manifest, files).collect()] == ["a"]


def test_library(spark):
    library = {
        "One": [{"key": "k1", "itemType": "journalArticle", "title": "A"}, {"key": "n", "itemType": "note"}, {"key": "v", "itemType": "videoRecording", "title": "V"}],
        "Two": [{"key": "v", "itemType": "videoRecording", "title": "V"}, {"key": "k2", "itemType": "journalArticle", "title": "B"}, {"key": "k1", "itemType": "journalArticle", "title": "A"}],
    }
    listed = lambda folder: library[folder]
    folders = spark.createDataFrame([(1, "Two"), (0, "One")], "nth long, folder string")
    records, skipped = ad.walk_library(folders, listed)
    assert {r.key: (r.title, r.folders) for r in records.collect()} == {"k1": ("A", ["One", "Two"]), "k2": ("B", ["Two"])}
    assert [tuple(r) for r in skipped.collect()] == [("v", "videoRecording", "V", "One")]
    clients = [("one", lambda k: {"title": "A"} if k == "k1" else None), ("two", lambda k: {"title": "B"} if k in ("k1", "k2") else None)]
    got = {tuple(r) for r in ad.first_known(spark.createDataFrame([("k1",), ("k2",), ("k3",)], "key string"), clients).collect()}
    assert got == {("k1", "one", "A"), ("k2", "two", "B"), ("k3", None, None)}


def test_model_calls(spark):
    def echo(prompt):
        if prompt == "fail":
            raise TimeoutError("late")
        return prompt.upper()

    prompts = spark.createDataFrame([("a", "hi"), ("b", "fail")], "paper_id string, prompt string")
    assert {tuple(r) for r in ad.call_model(prompts, echo).collect()} == {("a", "HI", 0, ""), ("b", None, 1, "TimeoutError: late")}
    stored = spark.createDataFrame([("a", "kept")], "paper_id string, reply string")
    assert {tuple(r) for r in ad.stored_replies(prompts, stored).collect()} == {("a", "kept", 0, ""), ("b", None, 1, "no stored reply")}
