"""Null, wide and text keys in every operator; the WARC files' damage; columns and types of the queries."""

import gzip

import public_tokenizers
import pytest

from braidline.llm import counting, decontaminate, language, packing, quality, queries, repeats, secrets, simhash, toxicity, warc

WORDS = public_tokenizers.path("word_bpe_49k.json")
WIDE = 2**60 + 1
PROSE = "the harbour was quiet and the boats lay still in the morning light of the day "
BENCH = "which planet of the solar system has the most moons according to the list that was made in the year"


def rows(keys):
    texts = [PROSE * 3, None, "", PROSE * 3, BENCH, PROSE + BENCH + PROSE, "password: hunter2hunter2 " + PROSE, "x" * 500]
    return [(k, t, "en", 1) for k, t in zip(keys, texts)]


@pytest.fixture(scope="module", params=["wide", "text"])
def docs(spark, request):
    wide = [WIDE, None, WIDE + 2, None, WIDE, WIDE, WIDE + 4, None]
    if request.param == "wide":
        return spark.createDataFrame(rows(wide), "doc_id long, text string, lang string, k int").coalesce(1), wide
    names = [None if k is None else f"d{k}" for k in wide]
    return spark.createDataFrame(rows(names), "doc_id string, text string, lang string, k int").coalesce(1), names


def keys_of(df):
    return sorted((r.doc_id for r in df.collect()), key=repr)


def test_keys_stay_exact(spark, docs):
    own, keys = docs
    kind = own.schema["doc_id"].dataType.simpleString()
    labels = spark.createDataFrame([(k, i % 2, i % 2) for i, k in enumerate(keys) if k is not None], f"doc_id {kind}, quality int, toxic int").dropDuplicates(["doc_id"])
    bench = spark.createDataFrame([(WIDE, BENCH)], "item_id long, text string")
    want = sorted(keys, key=repr)
    assert keys_of(packing.pack_documents(own, WORDS)) == want
    assert keys_of(language.identify(own)) == want
    assert keys_of(quality.judge(own, labels)) == want
    assert keys_of(counting.count_tokens(own, WORDS)) == want
    assert keys_of(simhash.near_duplicates(own)) == want
    assert keys_of(toxicity.score_toxicity(own, labels)) == want
    assert keys_of(secrets.find_secrets(own)) == want
    assert keys_of(repeats.remove_repeats(own)) == want
    found = decontaminate.contaminated(own, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(keys[4], WIDE)} and len(found) == 2
    pages = own.select("doc_id", own.lang.alias("url"), own.text.alias("html"))
    assert keys_of(warc.derive_pages(pages, key="doc_id")) == sorted(keys * 2, key=repr)


def test_filters_keep_columns_and_empty_tables(spark, docs):
    own, _ = docs
    own = own.withColumnRenamed("k", "_x").selectExpr("*", "1 AS _spans", "2 AS _blob", "3 AS _name", "4 AS t", "5 AS k", "6 AS row", "7 AS kept")
    bench = spark.createDataFrame([(1, BENCH)], "item_id long, text string")
    labels = spark.createDataFrame([], f"doc_id {own.schema['doc_id'].dataType.simpleString()}, quality int, toxic int")
    for stage in (simhash.keep_one, lambda d: decontaminate.drop_contaminated(d, bench), secrets.redact, lambda d: quality.keep_good(d, labels)):
        assert stage(own).columns == own.columns
        assert stage(own.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(own, bench).count() == 6
    assert decontaminate.drop_contaminated(own, bench.limit(0)).count() == 8
    masked = {r.text for r in secrets.redact(own).collect()}
    assert None in masked and not any("hunter2" in (t or "") for t in masked) and any("[SECRET]" in (t or "") for t in masked)
    kept = simhash.keep_one(own).collect()
    assert sorted(r.text or "" for r in kept) == sorted({t or "" for _, t, *_ in rows(range(8))})


def test_keep_one_of_equal_rows(spark):
    same = spark.createDataFrame([(1, PROSE)] * 50 + [(None, PROSE), (2, "something else in this row of words")], "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in simhash.keep_one(same).collect()) == [1, 2]


def test_warc_files_and_damage(spark):
    def record(kind, n, block):
        return warc.render([("WARC-Type", kind), ("WARC-Record-ID", f"<urn:{n}>"), ("WARC-Target-URI", f"http://x/{n}"), ("WARC-Date", "2024-01-01T00:00:00Z")], block)

    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<html><body><p>one</p><p>two \xc3\xa9</p></body></html>"
    good = gzip.compress(record("warcinfo", 0, b"")) + gzip.compress(record("response", 1, page)) + gzip.compress(record("response", 2, page))
    files = [("a", good), ("b", record("response", 3, page) + record("response", 4, page)[:-30]), ("c", b""), ("d", None), ("e", b"no archive"), ("f", good[:-20])]
    out = warc.derive_warc(spark.createDataFrame(files, "path string, content binary")).collect()
    seen = sorted((r.path, r.type, r.refers_to) for r in out if r.type != "damaged")
    whole = [(p, t, f"<urn:{n}>") for p, n in (("a", 1), ("a", 2), ("b", 3), ("f", 1)) for t in ("conversion", "metadata")]
    assert [x for x in seen if x != ("f", "conversion", "<urn:2>") and x != ("f", "metadata", "<urn:2>")] == sorted(whole)
    assert sorted(r.path for r in out if r.type == "damaged") == ["b", "e", "f"]
    for r in out:
        if r.type == "conversion":
            assert r.content == "one\ntwo é"
            (headers, block), = warc.parse(bytes(r.record))
            assert block.decode() == r.content and warc.first(headers, "WARC-Refers-To") == r.refers_to
            assert warc.first(headers, "WARC-Block-Digest") == warc.digest(block) == r.block_digest


#: What the contracts say that the queries return.
COLUMNS = {
    "op1_pack_swap_search": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op2_language_ecoc": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_quality_llr": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op5_token_counts_resync": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op7_simhash_popcount_grid": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op8_toxicity_gru": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_blob_ledger": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op10_radix_repeats": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_columns(spark, name):
    out = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
