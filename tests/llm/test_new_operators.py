"""Conversation repair, language identification and ranked search: plain versions, hard rows, ties, empty tables."""

import collections
import functools
import itertools
import math
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from httplens.llm import language, lexical, queries, repair  # noqa: E402
from httplens.llm.rows import importable  # noqa: E402
from httplens.llm.text import Words, ALNUM, blocks  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


# --- repair ------------------------------------------------------------------------------------


def cheapest(turns):
    """The least (cost, audit) from the end backwards, as tuples, for turns of (initial, must go, truncated)."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def rest(i, last, inserted):
        found = [(0, "")] if i == len(turns) and last in ("", "a") else []

        def then(letter, cost, after):
            found.extend((cost + c, letter + audit) for c, audit in [after] if audit is not None)

        if inserted < 2:
            for role in set(follows[last]) & set("ua"):
                then("I", 3, rest(i, role, inserted + 1))
        if i < len(turns):
            initial, gone, cut = turns[i]
            then("D", 4, rest(i + 1, last, 0))
            if not gone:
                if initial in follows[last]:
                    then("K", 3 * cut, rest(i + 1, initial, 0))
                for role in set(follows[last]) & set("ua"):
                    then("R", 3 + 3 * cut, rest(i + 1, role, 0))
        return min(found, default=(0, None))

    return rest(0, "", 0)


def by_weights(turns, piece=3):
    tables = [(repair.piece_table(turns[i:i + piece], tuple(range(4)) if i else (0,)), 2 * len(turns[i:i + piece]))
              for i in range(0, len(turns), piece)]
    while len(tables) > 1:
        (a, m), (b, n) = tables[:2]
        tables[:2] = [(repair.joined_tables(a, m, b, n), m + n)]
    return repair.finished(*tables[0])


def test_cheapest_repairs_and_first_of_equals():
    draw = random.Random(3)
    kinds = [(i, g, c) for i in "suax" for g in (False, True) for c in (False, True)]
    some = [[kind] for kind in kinds] + [list(t) for t in itertools.product([("s", False, False), ("u", False, False), ("a", False, True)], repeat=4)]
    some += [[draw.choice(kinds) for _ in range(draw.randint(2, 6))] for _ in range(120)]
    for turns in some:
        assert by_weights(turns) == cheapest(turns), turns


def test_a_weight_of_any_width():
    turns = [("u", False, False), ("u", False, False), ("a", False, False)] * 400
    assert by_weights(turns, piece=64) == by_weights(turns, piece=1200)


def conversation(spark, some):
    importable(spark)
    return spark.createDataFrame(some, "c long, t long, role string, text string, conv string, key string, no long, piece long, position long")


def wide(*row):
    return (*row, *[None] * 5)


def test_long_conversations_are_repaired_in_pieces(spark):
    """A conversation over many pieces, with a repeat far away, equals the same in one piece."""
    turns = [wide(7, k, "user" if k % 5 else "assistant", f"text {k}." if k % 11 else "again!") for k in range(1500)]
    turns += [wide(8, 1, "user", "hello."), wide(8, 2, "assistant", "yes")]
    found = repair.Repair(conversation(spark, turns), "c", "t")
    report = {r.c: r for r in found.report.collect()}
    seen, given = set(), []
    for _, _, role, text, *_ in turns[:1500]:
        given.append((role[0], (role, text) in seen, False))
        seen.add((role, text))
    assert (report[7].cost, report[7].audit) == repair.finished(repair.piece_table(given, (0,)), 3000)
    assert report[7].duplicate == sum(g for _, g, _ in given)
    rows = sorted(found.turns.where("c = 7").collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(len(rows))) and "".join(r.edit for r in rows) == report[7].audit.replace("D", "")
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in rows))
    assert (report[8].cost, report[8].audit, report[8].truncated) == (3, "KK", 1)


def test_hard_conversations(spark):
    some = [wide(None, None, None, None), wide(None, 2, "user", "a."), wide(1, 5, "user", "x" * 300_000 + "?"), wide(1, None, "system", "s!"),
            wide(1, 9, "assistant", "ok.\n\n"), wide(1, 9, "assistant", "ok.\n\n"), wide(2, 1, "", "?"), wide(3, 4, "assistant", " \t")]
    rows = conversation(spark, some)
    found = repair.Repair(rows, "c", "t")
    report = {r.c: r for r in found.report.collect()}
    assert (report[None].blank, report[None].audit, report[None].cost) == (1, "DKI", 7)
    assert (report[1].audit, report[1].duplicate, report[1].cost) == ("KKKD", 1, 4)
    assert (report[2].audit, report[2].cost) == ("D", 4) and (report[3].blank, report[3].audit) == (1, "D")
    assert {r.c: r.gaps for r in repair.gaps(rows, "c", "t").collect()} == {None: 0, 1: 3, 2: 0, 3: 0}
    assert {r.c for r in repair.turns_digest(found.turns, "c").collect()} == {None, 1}
    empty = repair.Repair(conversation(spark, []), "c", "t")
    assert empty.report.collect() == [] and empty.turns.collect() == []


def test_damage(spark):
    some = [wide(c, t, "assistant", "One. Two!") for c in range(40) for t in range(5)] + [wide(None, None, None, None)]
    found = collections.defaultdict(list)
    for r in repair.damaged(conversation(spark, some), "c", "t").collect():
        found[r.c, r.t].append((r.role, r.text))
    for c in range(40):
        for t in range(5):
            case = zlib.crc32(f"{c}:{t}".encode()) % 20
            want = {0: [], 1: [("assistant", "")], 2: [("assistant", "One Two")], 3: [("assistant", "One. Two!")] * 2, 4: [("user", "One. Two!")]}
            assert found.get((c, t), []) == want.get(case, [("assistant", "One. Two!")])


# --- language ----------------------------------------------------------------------------------

SYLLABLES = {"en": "the ing and tion er", "de": "der ung sch und ein", "fr": "que eau les ent oi", "es": "que cion los ar ra", "fi": "nen sta kaa ja on"}


def spoken(lang, n, seed):
    draw = random.Random(f"{lang}{seed}")
    return " ".join("".join(draw.choices(SYLLABLES[lang].split(), k=draw.randint(1, 3))) for _ in range(n))


DOCUMENT = "doc_id long, text string, lang string, source string, score double, found string, _text string, _key long, _lang string"


def documents(spark, some):
    importable(spark)
    return spark.createDataFrame([(*row, *[None] * 6) for row in some], DOCUMENT)


def test_families_and_languages_within_them(spark):
    some = [(100 * k + i, spoken(lang, 30 + i, i), lang) for k, lang in enumerate(SYLLABLES) for i in range(60)]
    docs = documents(spark, some)
    model = language.train(docs.where(~language.held_out("doc_id")), max_rows=100)
    assert sorted(map(tuple, model.families)) == [("de", "en"), ("es", "fr"), ("fi",)] and len(model.pairs) == 2
    found = docs.select("doc_id", "lang", language.held_out("doc_id").alias("held"), language.identified("text", model).alias("r")).collect()
    assert {r.held for r in found if r.doc_id % 7 == 0} == {True, False}
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.r.score <= 1 for r in found)
    held = [r.r.lang == r.lang for r in found if r.held]
    assert sum(held) >= 0.95 * len(held) and len(held) > 40


def test_hard_texts_have_a_language_or_none(spark):
    some = [(k, spoken(lang, 40, k), lang) for k, lang in enumerate(["en", "fr"] * 20)]
    some += [(1, spoken("en", 40, 1), "fr"), (None, spoken("en", 9, 1), "en"), (90, spoken("en", 9, 1), None)]
    docs = documents(spark, some)
    model = language.train(docs)
    hard = documents(spark, [(1, None, None), (2, "", None), (3, " 12 - !", None), (4, "é", None), (5, "日本語", None), (None, "the", None),
                             (7, spoken("fr", 60_000, 1), None), (7, spoken("fr", 60_000, 1), None), (8, "\U0001f600" * 9, None)])
    found = [(r.doc_id, r.r.lang, r.r.score) for r in hard.select("doc_id", language.identified("text", model).alias("r")).collect()]
    assert [(k, lang) for k, lang, _ in found] == [
        (1, "und"), (2, "und"), (3, "und"), (4, found[3][1]), (5, found[4][1]), (None, found[5][1]), (7, "fr"), (7, "fr"), (8, "und")]
    assert all(score == 0 if lang == "und" else 0 < score <= 1 for _, lang, score in found)
    assert {found[3][1], found[4][1], found[5][1]} <= {"en", "fr"}


def test_nothing_to_learn_from(spark):
    model = language.train(documents(spark, [(1, "text", None), (None, "text", "en")]))
    assert model is None
    assert documents(spark, [(1, "text", None)]).select(language.identified("text", model).alias("r")).head().r.lang == "und"
    alone = language.train(documents(spark, [(k, spoken("en", 9, k), "en") for k in range(5)]))
    assert documents(spark, [(1, "text", None)]).select(language.identified("text", alone).alias("r")).head().r.lang == "en"
    assert documents(spark, []).select(language.identified("text", alone).alias("r")).collect() == []


def test_slices_give_the_same_margins(monkeypatch):
    block, = blocks(pa.array(["the thing and", "", "eau é que"]))
    whole = language.frequencies(block)
    monkeypatch.setattr(language, "_SLICE", 3)
    assert np.array_equal(whole, language.frequencies(block)) and whole[1].sum() == 0


def test_language_of_held_out_documents(spark):
    found = queries.queries()["op12_language"](spark, SF_DIR)
    truth = {r.doc_id: r.lang for r in queries.table(spark, SF_DIR, "documents").collect()}
    rows = found.collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out and truth[r.doc_id]]
    assert sum(held) >= 0.97 * len(held) > 0


# --- ranked search -----------------------------------------------------------------------------


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def ranked(docs, items, top):
    """By the formula, document by document; documents as (key, text), items as texts."""
    counted = [(key, collections.Counter(terms(text))) for key, text in docs]
    held = [own for _, own in counted if own]
    total, df = sum(sum(own.values()) for own in held), collections.Counter(t for own in held for t in own)
    found = []
    for item, text in items:
        scores = []
        for key, own in counted:
            m = 50 + (50 * sum(own.values()) * len(held)) // max(1, total)
            score = sum(
                math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * ((1000000000 * own[t]) // (1000 * own[t] + 20 * m))
                for t in dict.fromkeys(terms(text)) if own[t])
            if score > 0:
                scores.append((-score, key is None, key))
        found += [(item, rank, key, -score) for rank, (score, _, key) in enumerate(sorted(scores)[:top], 1)]
    return found


def table(spark, some, schema):
    importable(spark)
    width = len(schema.split(",")) - 2
    return spark.createDataFrame([(*row, *[None] * width) for row in some], schema)


WIDE_DOCS = "doc_id long, text string, doc string, n long, m long, bag string, hash long, rank int, score long"


def searched(spark, docs, items, **options):
    found = lexical.search(table(spark, docs, WIDE_DOCS), table(spark, items, "item_id long, text string, rank int, doc_id long"), **options)
    return [(r.item_id, r.rank, r.doc_id, r.score) for r in found.collect()]


@pytest.mark.parametrize("max_terms", [1_000_000, 4])
def test_search_equals_the_formula(spark, max_terms, monkeypatch):
    monkeypatch.setattr(lexical, "_CELLS", 64)
    draw = random.Random(8)
    words = [f"w{k}" for k in range(30)] + ["Été", "ÉTÉ", "x1"]
    docs = [(k, " ".join(draw.choices(words, weights=[1 / (1 + i) for i in range(len(words))], k=draw.randint(0, 25)))) for k in range(200)]
    docs += [(300 + k, docs[k % 5][1]) for k in range(80)] + [(k, None) for k in range(400, 410)] + [(k, "W1 w2, W1") for k in range(500, 590)]
    items = [(k, " ".join(draw.choices(words, k=6))) for k in range(8)] + [(20, None), (21, "absent"), (22, "w1 W1 w1"), (23, "été")]
    want = collections.Counter(ranked(docs, items, 10))
    assert collections.Counter(searched(spark, docs, items, top=10, max_terms=max_terms)) == want


def test_search_of_hard_rows(spark):
    docs = [(1, "alpha beta"), (1, "alpha beta"), (None, "alpha beta"), (2, ""), (3, None), (4, "gamma " * 50_000 + "alpha"), (5, "ALPHA-Beta"), (6, "zeta")]
    items = [(1, "alpha"), (1, "alpha"), (None, "beta gamma"), (2, ""), (3, None)]
    found = searched(spark, docs, items)
    want = ranked(docs, items, 50)
    assert collections.Counter(found) == collections.Counter(want) and want
    assert searched(spark, [], items) == [] and searched(spark, docs, []) == []


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    """With a hash that is the same for all, every word still finds its own term."""
    monkeypatch.setattr(Words, "hashes", lambda self, block, seed=1, fold=None: np.zeros(len(self), np.uint64))
    vocabulary = lexical.Vocabulary([b"a", b"bc", b"bd", "é".encode()])
    block, = blocks(pa.array(["bd A x bc", "", "É é BC"]))
    assert vocabulary.numbers(block, Words(block, ALNUM)).tolist() == [2, 0, -1, 1, -1, 3, 1]
