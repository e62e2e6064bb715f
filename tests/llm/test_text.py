"""Operators 3, 4, 5, 8 and 10 against brute force, exact round trips and held-out accuracy, and their cases."""

import base64
import math
import random
from collections import Counter

import numpy as np
import pytest

from spanforge import storage
from spanforge.llm import bpe, chat, katz, langid, quality
from spanforge.llm.bytescan import Tokens
from spanforge.llm.common import read

DOCS = "doc_id long, text string, lang string, source string, score double, ids int, keep int"
TEXTS = ["Hello world, it's 42 o'clock", "", None, "   ", "été — naïve façade 日本語", "x" * 3000, "a\n\n  b\t c ", "<|endoftext|> is text", "!?" * 200, "Hello world, it's 42 o'clock"]


def docs_of(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, langs[i] if langs else "en", "s", 0.0, 1, 0) for i, t in enumerate(texts)], DOCS)


def test_bpe_equals_the_public_tokenizer(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(bpe.VOCABULARY, "rb"))}
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = docs_of(spark, TEXTS)
    got = {r.doc_id: r for r in bpe.encode_and_decode(docs).collect()}
    for i, t in enumerate(TEXTS):
        if t is None:
            assert got[i].ids is None and got[i].n_tokens is None and got[i].exact is None
        else:
            assert got[i].ids == other.encode_ordinary(t) and got[i].exact and got[i].n_tokens == len(got[i].ids)
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert [back[i] for i in range(len(TEXTS))] == TEXTS
    assert bpe.encode(docs.limit(0)).count() == 0


def test_lock_step_and_single_trees_agree():
    v = bpe.encoder(bpe.VOCABULARY).vocabulary
    rng = random.Random(1)
    words = ["".join(rng.choice("theandingo é") for _ in range(rng.randint(1, 60))).encode() for _ in range(400)]
    flat, count = v.encode_words(words)
    for w, ids in zip(words, np.split(flat, np.cumsum(count)[:-1])):
        assert ids.tolist() == v.encode_long(w)


def score_by_force(texts, trusted):
    """Mean ratio and least ratio of a word, from counts kept in dictionaries."""
    from spanforge.llm.bytescan import ngram_hash

    def grams(t):
        h = Tokens([t]).hash
        pairs = [ngram_hash(np.array(x), 2, np.zeros(2, int))[0][0] for x in zip(h, h[1:])]
        return [int(x) >> 44 for x in h], [int(x) >> 44 for x in pairs]

    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        for g in sum(grams(t), []):
            raw[g] += 1
            target[g] += i in trusted
    share = sum(target.values()) / sum(raw.values())
    some = max(quality.SMOOTHING, 1 / share)
    ratio = lambda g: math.log((target[g] / share + some) / (raw[g] + some))
    out = []
    for t in texts:
        words, pairs = grams(t)
        out.append((np.mean([ratio(g) for g in words + pairs]), min(ratio(g) for g in words)) if words else None)
    return out


def test_quality_equals_brute_force(spark):
    texts = TEXTS + ["good plain words here"] * 5 + ["*** ### $$$ *** ###"] * 5 + ["good words and " + "bad " * 900]
    trusted = {0, 4, 10, 11, 12}
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted] + [(15, 0, 0), (None, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, texts).withColumnsRenamed({"ids": "least"})
    rows = quality.score(docs, labels).collect()
    got = {r.doc_id: r for r in rows}
    for i, want in enumerate(score_by_force(texts, trusted)):
        if want is None:
            assert got[i].score is None and got[i].least is None and not got[i].keep
            continue
        assert (got[i].score, got[i].least) == pytest.approx(want, abs=2e-6)
        assert got[i].keep == (want[0] >= quality.THRESHOLD and want[1] >= quality.FLOOR)
    assert {r.keep for r in rows} == {True, False}
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.keep}
    none = quality.score(docs_of(spark, texts), labels.limit(0)).collect()
    assert all(r.score in (None, 0.0) for r in none)
    assert quality.score(docs_of(spark, texts).limit(0), labels).count() == 0


def test_quality_counts_are_shuffled_by_range_and_not_written(spark, monkeypatch):
    """A task sends packed ranges, not a row for each bucket, and no file is written to gather the counts."""
    texts = [" ".join(f"w{i}x{k}" for k in range(800)) for i in range(12)] + ["", None, "   "]
    docs, labels = docs_of(spark, texts).repartition(3), spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(storage, "fresh_path", lambda *a: pytest.fail("the counts are written"))
    ratio = quality.fit(docs, labels)
    assert (ratio != 0).sum() > 1 << 10  # more buckets than there are ranges
    rows = quality.counts(docs, labels).collect()
    assert len(rows) == len({r.at for r in rows}) <= 1 << (quality.BUCKET_BITS - quality.RANGE_BITS)
    sums = [sum(int(np.frombuffer(r[k], f"u{len(r[k]) >> quality.RANGE_BITS}").sum()) for r in rows) for k in ("raw", "target")]
    assert sums == [12 * (800 + 799), 5 * (800 + 799)]


@pytest.mark.parametrize("bits", [6, 10, 14])
def test_quality_ratios_equal_brute_force(spark, bits):
    """Also with fewer buckets than a range has, and in more tasks than one."""
    texts = TEXTS + [f"good words number {i}" for i in range(300)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 3)], "doc_id long, quality int, toxic int")
    raw, target = np.zeros((2, 1 << bits))
    for i, t in enumerate(texts):
        _, word, pair, _ = quality.features([t], bits)
        for b in [*word, *pair]:
            raw[b] += 1
            target[b] += i < 200 and i % 3 == 0
    share = target.sum() / raw.sum()
    some = max(quality.SMOOTHING, 1 / share)
    want = np.log((target / share + some) / (raw + some))
    assert quality.fit(docs_of(spark, texts).repartition(4), labels, bits=bits) == pytest.approx(want, abs=1e-6)


def test_quality_counts_of_any_size_are_packed():
    large = [0, 1, 255, 256, 65535, 65536, (1 << 32) - 1, 1 << 32, 1 << 40]
    sums = {k: np.array([[x] * 4, [x // 2] * 4], np.int64) for k, x in enumerate(large)}
    batch = quality._batch(sums)
    assert [len(x) for x in batch.column(1).to_pylist()] == [4, 4, 4, 8, 8, 16, 16, 32, 32]
    back = quality._add([batch, batch, quality._batch({})], 4)
    assert all((back[k] == 2 * x).all() for k, x in sums.items()) and len(back) == len(sums)


def test_quality_separates_labelled_junk(spark, smallest):
    sf = smallest.replace("0.001", "0.01")
    scored = quality.score(read(spark, sf, "documents"), read(spark, sf, "labels")).join(read(spark, sf, "labels"), "doc_id").collect()
    assert np.mean([r.keep for r in scored if r.quality == 1 and r.toxic == 0]) > 0.98
    assert np.mean([not r.keep for r in scored if r.quality == 0]) > 0.95


@pytest.mark.parametrize("part_turns", [4096, 3])
def test_chat_masks_equal_brute_force(spark, part_turns):
    """Against another encoder, that gives the offsets of its tokens in characters."""
    from tokenizers import Tokenizer

    rows = [(1, 0, "user", "hello thère"), (1, 1, "assistant", "answer éé one"), (1, 1, "assistant", "answer éé one"), (1, 2, None, None), (2, 0, "assistant", ""), (3, 0, "user", "x"), (None, 0, "assistant", "lost"), (4, None, "assistant", "w " * 3000), (4, 5, "user", "日本")]
    rows += [(5, 3, "assistant", " same \n")] * 7 + [(5, k, "user" if k % 2 else "assistant", f"\n turn {k}  ") for k in range(5)]
    conv = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, ids string, part int")
    got = {}
    for r in chat.chat_format(conv, part_turns=part_turns).orderBy("conv_id", "part").collect():
        assert r.n_turns <= part_turns and r.n_tokens == len(r.ids) == len(r.loss_mask) and r.n_trained == sum(r.loss_mask)
        have = got.setdefault(r.conv_id, [0, [], []])
        have[0] += r.n_turns
        have[1] += r.ids
        have[2] += r.loss_mask
    assert set(got) == {1, 2, 3, 4, 5} and got[1][0] == 4 and not any(got[3][2])
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for c, (n, ids, mask) in got.items():
        turns = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or ""))
        text, inside = "", []
        for _, _, who, said in turns:
            head, body = f"<|{who or 'unknown'}|>\n", f"{said or ''}<|end|>"
            inside += [(False, len(head)), (who == "assistant", len(body)), (False, 1)]
            text += head + body + "\n"
        trained = [x for x, size in inside for _ in range(size)]
        e = t.encode(text, add_special_tokens=False)
        assert n == len(turns) and ids == e.ids and t.decode(ids) == text
        assert mask == [int(any(trained[a:b])) for a, b in e.offsets]
    assert chat.chat_format(conv.limit(0)).count() == 0


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    emit, trans, start = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    first, count = np.array([0, 4, 4]), np.array([4, 0, 5])
    pairs = np.zeros((3, 3))
    post = langid.posteriors(emit, first, count, trans, start, pairs)
    expected = np.zeros((3, 3))
    for lo, n in ((0, 4), (4, 5)):
        total, mass = 0.0, np.zeros((n, 3))
        edges = np.zeros((3, 3))
        for path in np.ndindex(*[3] * n):
            s = start[path[0]] + sum(emit[lo + k, y] for k, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:]))
            w = math.exp(s)
            total += w
            for k, y in enumerate(path):
                mass[k, y] += w
            for a, b in zip(path, path[1:]):
                edges[a, b] += w
        assert np.allclose(post[lo : lo + n], mass / total)
        expected += edges / total
    assert np.allclose(pairs, expected)


def test_language_id_held_out(spark, smallest):
    docs = read(spark, smallest.replace("0.001", "0.01"), "documents")
    train_on, held_out = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = langid.fit(train_on, 80)
    rows = held_out.collect()
    tokens, _, share = langid.classify([r.text for r in rows], model)
    right = np.array([model.langs[k] == r.lang for k, r in zip(share.argmax(1), rows)])
    assert right[tokens.count >= 5].mean() > 0.97
    # a spliced text: words of two documents one after the other
    by = {}
    for r in rows:
        if len(r.text) > 600:
            by.setdefault(r.lang, r.text[:500])
    a, b = by["en"], by["es"]
    tokens, post, _ = langid.classify([a + " " + b], model)
    n = Tokens([a], punct=False).count[0]
    label = np.array(model.langs)[post.argmax(1)]
    assert (label[: n - 1] == "en").mean() > 0.9 and (label[n + 1 :] == "es").mean() > 0.9


def crf_by_force(texts, model):
    """Viterbi-free: the posterior of each word by summing over all paths, word features one by one."""
    out = []
    for t in texts:
        tokens = Tokens([t], punct=False)
        n, k = len(tokens.hash), len(model.langs)
        emit = np.zeros((n, k))
        for i in range(n):
            ids, _ = langid.word_features(tokens, np.array([i]))
            emit[i] = sum(model.weights[x] for x in ids)
            lex = model.lexicon(tokens.hash[i : i + 1])[0]
            if lex >= 0:
                emit[i] += model.lex_weight[lex]
        mass, total = np.zeros((n, k)), 0.0
        for path in np.ndindex(*[k] * n):
            w = math.exp(model.first[path[0]] + sum(emit[i, y] for i, y in enumerate(path)) + sum(model.trans[x, y] for x, y in zip(path, path[1:])))
            total += w
            for i, y in enumerate(path):
                mass[i, y] += w
        out.append(mass / total)
    return out


def test_identify_equals_brute_force(spark):
    texts = ["the house and the garden", "der hund und die katze", "the house und die katze", "la casa y el jardin de", "el perro and the cat"] * 4 + ["casa", None, "?!"]
    docs = docs_of(spark, texts, ["en", "de", None, "es", None] * 4 + ["es", "en", "en"])
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    for i, post in enumerate(crf_by_force([t for t in texts[:21]], model)):
        mean = post.mean(0)
        label = [model.langs[y] for y in post.argmax(1)]
        assert got[i].lang_id == model.langs[int(mean.argmax())] and got[i].confidence == pytest.approx(mean.max(), abs=2e-4)
        assert [x for s in got[i].spans for x in [s.lang] * (s.last - s.first)] == label
        assert got[i].n_switches == sum(a != b for a, b in zip(label, label[1:]))
        assert got[i].keep == (got[i].confidence >= langid.CONFIDENCE)


def test_language_id_trains_on_each_language_and_any_id(spark):
    many = ["the house and the garden of it"] * 900 + ["der hund und die katze sind da"] * 3
    langs = ["en"] * 900 + ["de"] * 3
    for ids in ([None] * 903, [7] * 903, list(range(903))):
        docs = spark.createDataFrame([(i, t, g) for i, t, g in zip(ids, many, langs)], "doc_id long, text string, lang string")
        from spanforge.llm.common import smallest_hashes

        sample = smallest_hashes(docs, 50, "doc_id", "text", by="lang").groupBy("lang").count().collect()
        assert {r.lang: r["count"] for r in sample} == {"en": 50, "de": 3}
        assert smallest_hashes(docs, 50, "doc_id").count() == 50
        assert langid.keep(docs).count() == 903
        assert {r.lang_id for r in langid.identify(docs).collect()} == {"en", "de"}


def test_language_id_reads_whole_texts(spark):
    # what tells the two apart stands behind thousands of equal characters
    same = "x1 " * 3000
    docs = docs_of(spark, [same + "the house and the garden"] * 5 + [same + "der hund und die katze"] * 5 + ["the house and the garden", "der hund und die katze"], ["en"] * 5 + ["de"] * 5 + [None] * 2)
    got = {r.doc_id: r.lang_id for r in langid.identify(docs).collect()}
    assert got[10] == "en" and got[11] == "de"


def test_language_id_cases(spark):
    texts = ["the house and the garden of it"] * 6 + ["der hund und die katze sind da"] * 6 + [None, "", "!!! ???", "the house und die katze"]
    langs = ["en"] * 6 + ["de"] * 6 + [None] * 4
    docs = docs_of(spark, texts, langs)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert got[0].lang_id == "en" and got[7].lang_id == "de" and [tuple(s) for s in got[0].spans] == [(0, 7, "en")]
    for i in (12, 13, 14):
        assert got[i].lang_id is None and got[i].confidence == 0 and not got[i].keep and got[i].spans == []
    assert [s.lang for s in got[15].spans] == ["en", "de"] and got[15].n_switches == 1
    kept = langid.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.keep}
    blind = langid.identify(docs_of(spark, texts, [None] * 16)).collect()
    assert len(blind) == 16 and not any(r.keep for r in blind) and all(r.lang_id is None for r in blind)
    assert langid.identify(docs.limit(0)).count() == 0


def whole_katz_by_force(texts, order, k=katz.K, others=()):
    """All orders, all words and all counts, with a backoff weight for each context of each order.

    Tokens and log probability of each text, or of each of the ``others``, with the number of their unknown words.
    """
    seqs = [[int(h) for h in Tokens([t]).hash] for t in texts]
    uni = Counter(w for s in seqs for w in s)
    lower = {(): {w: c / sum(uni.values()) for w, c in uni.items()}}

    def below(ctx, w):
        if not ctx:
            return lower[()][w]
        if ctx not in lower:
            return below(ctx[1:], w)
        p, bow = lower[ctx]
        return p[w] if w in p else bow * below(ctx[1:], w)

    for m in range(2, order + 1):
        after = {}
        for s in seqs:
            padded = ["<s>"] * (m - 1) + s
            for j, w in enumerate(s):
                after.setdefault(tuple(padded[j : j + m - 1]), Counter())[w] += 1
        n = np.array([0] + [sum(c == r for a in after.values() for c in a.values()) for r in range(1, k + 2)])
        d = katz.discounts(n, k)
        level = {}
        for ctx, a in after.items():
            c = sum(a.values())
            p = {w: d[min(r, k + 1)] * r / c for w, r in a.items()}
            seen, rest = sum(p.values()), 1 - sum(below(ctx[1:], w) for w in a)
            if len(a) == len(uni):
                level[ctx] = ({w: x / seen for w, x in p.items()}, 0.0)
                continue
            if seen > 1 - 1e-12:
                p = {w: x * c / (c + 1) for w, x in p.items()}
            level[ctx] = (p, (1 - sum(p.values())) / rest)
        lower.update(level)
    if len(uni) < 100:
        for ctx in list(lower)[1:]:
            assert sum(below(ctx, w) for w in uni) == pytest.approx(1)
    pad = ["<s>"] * (order - 1)
    if others:
        out = []
        for t in others:
            s = [int(h) for h in Tokens([t]).hash]
            known = [j for j, w in enumerate(s) if w in uni]
            # an unknown word is in no context of the model
            out.append((len(s), len(s) - len(known), sum(math.log(below(tuple((pad + s)[j : j + order - 1]), s[j])) for j in known)))
        return out
    return [(len(s), sum(math.log(below(tuple((pad + s)[j : j + order - 1]), w)) for j, w in enumerate(s))) for s in seqs]


def assert_scores(rows, want):
    got = {r.doc_id: r for r in rows}
    assert len(got) == len(want)
    for i, (n, s) in enumerate(want):
        assert got[i].n_tokens == n and got[i].logprob == pytest.approx(s, rel=2e-5, abs=1e-9)
        assert got[i].perplexity == (pytest.approx(math.exp(-s / n), rel=1e-4) if n else None)


@pytest.mark.parametrize("order,types", [(2, 60), (2, 2), (3, 60), (3, 3), (4, 5)])
def test_whole_katz_equals_brute_force(spark, order, types):
    rng = random.Random(order)
    vocab = ["".join(rng.choice("abcde") for _ in range(6)) for _ in range(types)]
    texts = [" ".join(vocab[min(types - 1, int(rng.expovariate(0.3)))] for _ in range(rng.randint(1, 80))) for _ in range(60)]
    texts += ["", None, "   ", texts[0], vocab[0], f"{vocab[1]} " * 500]
    want = whole_katz_by_force(texts, order)
    docs = docs_of(spark, texts)
    for bucket_tokens in (100, 10**6):  # the first spreads the frequent contexts
        assert_scores(katz.score(docs, order, bucket_tokens=bucket_tokens).collect(), want)
    assert katz.score(docs.limit(0), order).count() == 0
    # the stored model gives the same, and scores other texts by recursion
    model = katz.fit(docs, order)
    assert_scores(model.score(docs).collect(), want)
    others = [" ".join(rng.choice(vocab) for _ in range(30)), "an unknown word " + vocab[0], texts[3] + " " + texts[7], "", None, "none of it known"]
    got = {r.doc_id: r for r in model.score(docs_of(spark, others)).collect()}
    for i, (n, unknown, value) in enumerate(whole_katz_by_force(texts, order, others=others)):
        assert (got[i].n_tokens, got[i].n_unknown) == (n, unknown)
        assert got[i].logprob == pytest.approx(value, rel=2e-5, abs=1e-9)
        assert got[i].perplexity == (pytest.approx(math.exp(-value / (n - unknown)), rel=1e-4) if n > unknown else None)


@pytest.mark.parametrize("order,types", [(2, 60), (2, 2), (3, 60), (3, 3), (4, 5)])
def test_the_scores_of_the_query_back_off(spark, order, types):
    """``score`` itself has the lower orders and the backoff weights: other texts need them, whatever contexts are spread."""
    rng = random.Random(order)
    vocab = ["".join(rng.choice("abcde") for _ in range(6)) for _ in range(types)]
    texts = [" ".join(vocab[min(types - 1, int(rng.expovariate(0.3)))] for _ in range(rng.randint(1, 80))) for _ in range(60)] + [f"{vocab[1]} " * 500, "", None]
    others = [" ".join(rng.choice(vocab) for _ in range(30)), "an unknown word " + vocab[0], texts[3] + " " + texts[7], "", None, "none of it known", texts[5]]
    for bucket_tokens in (40, 1000, 10**6):
        got = {r.doc_id: r for r in katz.score(docs_of(spark, texts), order, bucket_tokens=bucket_tokens, others=docs_of(spark, others)).collect()}
        assert len(got) == len(others)
        for i, (n, unknown, value) in enumerate(whole_katz_by_force(texts, order, others=others)):
            assert got[i].n_tokens == n and got[i].logprob == pytest.approx(value, rel=2e-5, abs=1e-9)
            assert got[i].perplexity == (pytest.approx(math.exp(-value / (n - unknown)), rel=1e-4) if n > unknown else None)


def test_no_word_of_a_large_vocabulary_is_pooled(spark, tmp_path):
    from spanforge.llm.queries import op10_lm_scoring

    rng = random.Random(5)
    rare = [f"r{i}" for i in range(66_000)]
    texts = [" ".join(rare[i : i + 600]) for i in range(0, 66_000, 600)] + [" ".join(rng.choice("abcdefgh") for _ in range(200)) for _ in range(20)]
    texts += [" ".join(["r5", "b"] * 3)]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    assert_scores(op10_lm_scoring(spark, str(tmp_path)).collect(), whole_katz_by_force(texts, katz.ORDER))


def test_lm_scoring_is_a_trigram_model_with_all_counts(spark, smallest):
    from spanforge.llm.queries import op10_lm_scoring

    docs = sorted((r.doc_id, r.text) for r in read(spark, smallest, "documents").collect())
    want = whole_katz_by_force([t for _, t in docs], 3)
    got = {r.doc_id: r for r in op10_lm_scoring(spark, smallest).collect()}
    assert len(got) == len(docs)
    for (i, _), (n, s) in zip(docs, want):
        assert got[i].n_tokens == n and got[i].logprob == pytest.approx(s, rel=2e-5, abs=1e-9)
