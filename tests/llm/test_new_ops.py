"""Fill-in-middle, SentencePiece encoding and collocations against plain code, on odd rows, and on given tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from foliospark.llm import collocations, fim, pieces
from tests.llm.test_llm import ODD, SF, empty, odd_docs

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(MODEL)


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


# ---- fill in middle


@pytest.mark.parametrize("blocks", [(b"", b""), (b"a", b""), (b"", b"b"), (b"ab", b"xyz"), (b"abcde", b"x")])
def test_exchange_swaps_blocks_in_place(blocks):
    a, b = blocks
    buf = bytearray(b"<" + a + b + b">")
    fim.exchange(buf, 1, 1 + len(a), 1 + len(a) + len(b))
    assert buf == b"<" + b + a + b">"


def plain_fim(text, doc_id):
    """The contract by slices of the text."""
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_transform_equals_slices_and_restores():
    draw = random.Random(5)
    forms = set()
    for k in range(4000):
        text = "".join(draw.choice(["a", "é", "😀", "<", ">", "P>", "S", "<S", "M>", "\n", "中"]) for _ in range(draw.randrange(12)))
        form, p, m, out = fim.transform(text, k)
        assert (form, p, m, out.decode()) == plain_fim(text, k)
        assert fim.restore(out, form).decode() == text
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_fim_on_odd_rows(spark):
    rows = fim.restored(fim.fill_in_middle(odd_docs(spark))).collect()
    assert len(rows) == 32
    for r in rows:
        text = {i: ODD[i % len(ODD)] for i in range(30)}.get(r.doc_id, ODD[7]) or ""
        assert r.n == len(text) and r.restored.decode() == text
        assert (r.form == "plain") == (r.prefix_chars is None) == (r.middle_chars is None)
        if r.doc_id is not None:
            assert (r.form, r.prefix_chars, r.middle_chars, r.output.decode()) == plain_fim(text, r.doc_id)
    assert fim.restored(fim.fill_in_middle(empty(spark))).collect() == []


def test_fim_parameters():
    assert {fim.transform("some text", k, fim.FimParams(transformed=100, suffix_first=100))[0] for k in range(50)} == {"spm"}
    assert {fim.transform("some text", k, fim.FimParams(transformed=0))[0] for k in range(50)} == {"plain"}


# ---- pieces


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def library(model, text):
    return model.model.encode(text, add_bos=True, add_eos=True)


def test_encoding_equals_the_library_on_all_documents(spark, model):
    rows = pieces.op13_sentencepiece(spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = library(model, texts[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == sha(np.array(want, "<u4").tobytes())
        assert r.decoded_sha256 == sha(model.model.decode(want))


@pytest.mark.parametrize("seed", range(3))
def test_encoding_equals_the_library_on_random_texts(model, seed):
    draw = random.Random(seed)
    signs = "abcdeinrst   \n\t\r\x00▁▁.;)('\"<>/*{}#0123éüß²ª中文日本語한😀‍́"
    some = sorted(p.replace("▁", " ") for p in model.text)
    for _ in range(3000):
        text = "".join(draw.choice(signs if seed < 2 else some) for _ in range(draw.randrange(30 if seed < 2 else 8)))
        assert ids_of(model.encode(text)) == library(model, text), text


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 5_000, "ab" * 10_000, "the" * 9_000, "中" * 5_000, "é\n" * 3_000, "<s></s><unk><0x0A>"])
def test_long_and_repeating_runs(model, text):
    ids = model.encode(text)
    assert ids_of(ids) == library(model, text)
    assert model.decode(ids) == model.model.decode(library(model, text))


def test_fit_equals_merging_again(model):
    """The check across the border of two pieces, against merging both strings from their characters."""
    draw = random.Random(11)
    found, at = set(), {p: k for k, p in enumerate(model.text)}
    for _ in range(20_000):
        a, b = draw.randrange(len(model.text)), draw.randrange(len(model.text))
        if draw.random() < 0.5:  # two parts of one piece, which more often meet
            whole = model.text[a]
            cut = draw.randrange(1, len(whole) + 1)
            if whole[:cut] not in at or whole[cut:] not in at:
                continue
            a, b = at[whole[:cut]], at[whole[cut:]]
        pair = [model.text[a], model.text[b]]
        want = model.merge("".join(pair))[0] == pair
        assert model.after[a][b] == want, pair
        found.add(want)
    assert found == {True, False}


def test_backtracking_takes_pieces_back(model):
    """Greedy longest matches are wrong for some words; backtracking is not."""
    wrong = 0
    draw = random.Random(2)
    for _ in range(3000):
        run = "▁" + "".join(draw.choice("aeinorstlmdh") for _ in range(10))
        longest, pos, greedy = model.longest(run), 0, []
        while pos < len(run):
            greedy.append(longest[len(run) - 1 - pos])
            pos += model.size[greedy[-1]]
        found = model.backtrack(run)
        wrong += found != greedy
        assert [model.text[k] for k in found] == model.merge(run)[0]
    assert wrong > 100


def test_pieces_on_odd_rows(spark, model):
    rows = pieces.decode_pieces(pieces.encode_pieces(odd_docs(spark))).collect()
    assert len(rows) == 32
    for r in rows:
        text = {i: ODD[i % len(ODD)] for i in range(30)}.get(r.doc_id, ODD[7]) or ""
        assert ids_of(bytes(r.ids)) == library(model, text) and r.text == model.model.decode(library(model, text))
    assert pieces.decode_pieces(pieces.encode_pieces(empty(spark))).collect() == []


def test_remembered_runs_are_bounded(model, monkeypatch):
    monkeypatch.setattr(pieces, "RUNS", 50)
    fresh = pieces.Runs(model)
    for k in range(500):
        fresh[f"▁w{k}"]
    assert len(fresh) <= 51 and len(fresh.old) <= 51
    assert fresh["▁w0"] == model.encode_run("▁w0")


# ---- collocations


def plain_collocations(rows, least, longest=4, top=2000, share=80):
    """The contract by plain loops over (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = {}
    for (lang, w), a in candidates.items():
        longer = [b for (g, v), b in candidates.items() if g == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= share * a for b in longer):
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def collocation_rows(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def random_rows(seed, n=120):
    draw = random.Random(seed)
    vocabulary = ["a", "b", "c", "dd", "É", "Ünïcode", "x\x0by", "A", "\x1f", "中", "a b"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "?", "\x0c"]
    return [(draw.choice(["en", "fr", None, "und"]), "".join(draw.choice(vocabulary) + draw.choice(ends) for _ in range(draw.randrange(60))) if draw.random() > 0.1 else None) for _ in range(n)]


@pytest.mark.parametrize("seed,least", [(1, 4), (2, 12), (3, 30)])
def test_collocations_equal_plain_loops(spark, seed, least):
    rows = random_rows(seed)
    docs = spark.createDataFrame([(r[0], r[1], "clash", 1) for r in rows], "lang string, text string, word string, a long").repartition(5)
    want = plain_collocations(rows, least)
    assert want and collocation_rows(collocations.top_collocations(docs, least)) == want


def test_collocations_of_one_word_overlap(spark):
    """One phrase in a third of all rows, and a word that repeats: every overlapping occurrence counts."""
    rows = [("en", "w w w w w")] * 40 + [("en", "w w w. w")] * 5 + [("fr", None), (None, ""), ("de", "one two")]
    got = collocation_rows(collocations.top_collocations(spark.createDataFrame(rows, "lang string, text string"), 30))
    assert got == plain_collocations(rows, 30) and ("en", 1) == got[0][:2]
    assert {r[2]: r[3] for r in got if r[0] == "en"} == {"w w w w": 80, "w w w": 125, "w w": 170}


def test_collocations_limit_and_ties(spark):
    rows = [("en", f"k{i} v{i}") for i in range(40) for _ in range(3)]
    got = collocation_rows(collocations.top_collocations(spark.createDataFrame(rows, "lang string, text string"), 3, top=7))
    assert got == plain_collocations(rows, 3, top=7) and [r[2] for r in got] == sorted(f"k{i} v{i}" for i in range(40))[:7]


def test_colliding_keys_are_counted_again(spark):
    """Keys of few bits collide under some seeds; results stay exact."""
    rows = random_rows(9)
    docs = spark.createDataFrame(rows, "lang string, text string")
    tried = [collocations.word_counts(docs, seed, 9).groupBy("key").count().where("count > 1").count() for seed in range(2)]
    assert tried[0] > 0
    assert collocation_rows(collocations.top_collocations(docs, 4, bits=9)) == plain_collocations(rows, 4)


def test_large_tables_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SMALL", 2)
    rows = random_rows(4)
    assert collocation_rows(collocations.top_collocations(spark.createDataFrame(rows, "lang string, text string"), 5)) == plain_collocations(rows, 5)


def test_collocations_on_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert collocation_rows(collocations.top_collocations(docs, 6)) == plain_collocations(rows, 6)
    assert collocations.top_collocations(empty(spark)).collect() == []


def test_relations_meet_without_an_exchange(spark):
    rows = spark.range(4000).selectExpr("id % 50 as row", "id div 50 as at", "id % 7 as g").repartition(3, "row")
    name = collocations.keep(rows, 3)
    with collocations.merged_by_bucket(spark):
        plan = collocations.adjacent(spark.table(name))._jdf.queryExecution().executedPlan().toString()
    collocations.drop(spark, name)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
