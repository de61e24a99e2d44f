"""Every optional query: against its SQL, or against a plain Python version, on the smallest tables."""

import collections
import hashlib
import os
import re
import sys
import zlib
from pathlib import Path

import duckdb
import pytest
import tokenizers

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from httplens.llm import oracle, queries  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL, QUERIES = oracle.oracle_sql(), queries.queries()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "pages", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def texts(duck):
    return {k: t or "" for k, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(r[c] for c in columns) for r in df.collect())
    cursor = duck.execute(SQL[name])
    place = {d[0]: i for i, d in enumerate(cursor.description)}
    assert sorted(place) == columns
    assert got == collections.Counter(tuple(r[place[c]] for c in columns) for r in cursor.fetchall())


def whole_and_tight(pieces, wanted_ids, crc):
    """Each document's pieces are its ids, without gap; sequences have no hole and little padding."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(wanted_ids)
    for doc, own in by_doc.items():
        ids, at = wanted_ids[doc], 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert crc(p) == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[p["start"]:at]))
        assert at == len(ids)
    used = padded = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 1024
        used += at
        padded += at if at & (at - 1) == 0 else 1024
    assert used >= 0.98 * padded


def ids_of(texts):
    encode = tokenizers.Tokenizer.from_file(queries.tokenizer_files()[0]).encode
    return {k: [*encode(t, add_special_tokens=False).ids, 0] for k, t in texts.items()}


def test_packing(spark, texts):
    wanted = ids_of(texts)
    pieces = rows(QUERIES["op1_packing"](spark, SF_DIR))
    whole_and_tight(pieces, wanted, lambda p: p["ids_crc32"])
    # Shorter tiers hold shorter documents, and are full.
    used = collections.Counter()
    for p in pieces:
        used[p["tier"], p["sequence_id"]] += p["length"]
    for tier in (256, 512):
        assert all(n == tier for (t, _), n in used.items() if t == tier)
        assert sum(p["length"] for p in pieces if p["tier"] == tier and p["doc_tokens"] <= tier) >= 0.9 * sum(
            n for (t, _), n in used.items() if t == tier)
    assert sum(n for (t, _), n in used.items() if t < 1024) >= 0.01 * sum(used.values())


def test_quality_on_held_out_labels(spark, duck, texts):
    found = rows(QUERIES["op4_quality"](spark, SF_DIR))
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    labels = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    judged = [r["predicted"] == labels[r["doc_id"]] for r in found if r["held_out"] and r["doc_id"] in labels]
    assert judged and sum(judged) >= 0.8 * len(judged)


def test_secrets_are_where_they_are_said_to_be(spark, texts):
    for r in rows(QUERIES["op6_secrets"](spark, SF_DIR)):
        finding = texts[r["doc_id"]][r["start_char"]:r["end_char"]]
        assert hashlib.sha256(finding.encode()).hexdigest() == r["finding_sha256"]
        assert r["is_secret"] == (r["score"] >= 0.5)


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def holds(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "card":
            return 12 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    found = [(m.start(), k, m.end(), kind) for k, kind in enumerate(KINDS) for m in re.finditer(BASE[kind], text)
             if holds(kind, m.group())]
    return [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found)]


def test_personal_data_base(spark, texts):
    for r in rows(QUERIES["op8_pii"](spark, SF_DIR)):
        base = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s.startswith(k + ":") for s in base) for k in KINDS]
        assert set(base) <= set(r["spans"].split(",")) or not base


def test_fingerprints(spark, texts):
    found = {r["doc_id"]: r for r in rows(QUERIES["op9_fingerprints"](spark, SF_DIR))}
    assert set(found) == set(texts)
    order = sorted(texts, reverse=True)
    by_text = collections.defaultdict(set)
    for doc, after in zip(order, order[1:] + order[:1]):
        text, r = texts[doc], found[doc]
        half = len(text) // 2
        edited = text[:len(text) - half] + texts[after][:half]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text[text].add(r["fingerprint"])
        by_text[edited].add(r["edited_fingerprint"])
    assert all(len(prints) == 1 for prints in by_text.values())
    long = [r for r in found.values() if r["n_chars"] >= 2000]
    assert sum(r["near_edited"] for r in long) > 2 * sum(r["near_next"] for r in long)


def test_pipeline_stages(spark, duck):
    """Each stage against a plain version on its own input."""
    docs = queries.table(spark, SF_DIR, "documents")
    stages = dict(corpus_pipeline.STAGES)
    kept = {}
    for name in ("quality", "near_duplicates", "decontamination", "secrets"):
        out = stages[name](spark, docs, SF_DIR)
        assert out.columns == docs.columns
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before) and after
        kept[name] = before, after
        docs = spark.createDataFrame(list(after.values()), docs.schema)

    before, after = kept["near_duplicates"]
    sets = {k: shingles(r.text or "") for k, r in before.items()}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert set(after) == {find(k) for k in sets}

    before, after = kept["decontamination"]
    duck.register("seen", spark.createDataFrame(list(before.values()), docs.schema).select("doc_id", "text").toPandas())
    dirty = duck.execute(
        f"SELECT doc_id FROM ({SQL['op3_contamination'].replace('FROM documents', 'FROM seen')}) WHERE contaminated").fetchall()
    assert set(after) == set(before) - {k for k, in dirty}

    before, after = kept["secrets"]
    assert set(after) == set(before)
    assert all(after[k].n_chars == len(after[k].text or "") for k in after)

    pieces = rows(stages["packing"](spark, docs, SF_DIR))
    whole_and_tight(pieces, ids_of({k: r.text or "" for k, r in after.items()}), lambda p: p["ids_crc32"])


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
