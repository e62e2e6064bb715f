"""The pipeline against a slow version of its own, and each stage on its own input."""

import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa

import __spark_entry__
import corpus_pipeline
from spanforge.llm import bpe, langid, linededup, packing, quality, simhash
from spanforge.llm.bytescan import Tokens
from spanforge.llm.common import map_texts, read
from tests.llm.test_bins import bfd, improvements, size_of
from tests.llm.test_dedup import groups_by_force, strip_by_force
from tests.llm.test_text import score_by_force

CLASHING = ("removed", "gone", "f0", "hashes", "keep", "__text")


def confidence_by_force(text, model, known):
    """The highest mean posterior of a language over the words, by forward and backward sums word for word."""
    tokens = Tokens([text], punct=False)
    n, k = len(tokens.hash), len(model.langs)
    if not n:
        return None
    emit = []
    for i, h in enumerate(tokens.hash.tolist()):
        if h not in known:
            ids, _ = langid.word_features(tokens, np.array([i]))
            e = sum(model.weights[x] for x in ids)
            lex = model.lexicon(tokens.hash[i : i + 1])[0]
            known[h] = [float(np.exp(v + (model.lex_weight[lex][y] if lex >= 0 else 0) - e.max())) for y, v in enumerate(e)]
        emit.append(known[h])
    step = np.exp(model.trans).tolist()
    forward = [[emit[0][y] * float(np.exp(model.first[y])) for y in range(k)]]
    for e in emit[1:]:
        at = [e[y] * sum(forward[-1][x] * step[x][y] for x in range(k)) for y in range(k)]
        forward.append([a / sum(at) for a in at])
    backward = [[1.0] * k]
    for e in emit[:0:-1]:
        at = [sum(step[x][y] * e[y] * backward[-1][y] for y in range(k)) for x in range(k)]
        backward.append([a / sum(at) for a in at])
    total = [0.0] * k
    for f, b in zip(forward, backward[::-1]):
        both = [x * y for x, y in zip(f, b)]
        total = [t + x / sum(both) for t, x in zip(total, both)]
    return max(total) / n


def fixture(spark, smallest, at):
    """The smallest documents, labels for them, and rows of every awkward kind with further columns."""
    rng = random.Random(4)
    docs = [tuple(r) for r in read(spark, smallest, "documents").select("doc_id", "text", "lang", "source").collect()]
    shared = ["Share this page with friends", "ok.", "All rights are reserved here"]
    rows = [(i, f"{t}\n{shared[i % 3]}" if i % 4 == 0 else t, g, f"site{i % 23}") for i, t, g, _ in docs]
    long_ = [t for _, t, *_ in rows if len(t) > 800]
    rows += [(5000 + k, t.replace(" the ", " a ", 1), "en", "s") for k, t in enumerate(long_[:12])]
    rows += [(None, long_[3], "en", "s"), (None, None, None, None), (6000, None, "en", "s"), (6001, "", None, "s"), (6002, "?! --", "en", "s"), rows[7], rows[7], (rows[8][0], long_[5] + " and more", "en", "s")]
    rows += [(6003, " ".join(rng.choice(long_).split()[k % 50] for k in range(9000)), "en", "s")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHING)
    spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *[1] * len(CLASHING)) for r in rows], schema).write.parquet(f"{at}/documents.parquet")
    labels = [tuple(r) for r in read(spark, smallest, "labels").select("doc_id", "quality", "toxic").collect()] + [(None, 1, 0), (5000, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return rows, labels


def test_pipeline_equals_brute_force(spark, smallest, tmp_path):
    rows, labels = fixture(spark, smallest, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    # quality
    good = {i for i, q, t in labels if i is not None and q == 1 and not t}
    found = score_by_force([r[1] for r in rows], {k for k, r in enumerate(rows) if r[0] in good})
    kept = [r for r, s in zip(rows, found) if s and s[0] >= quality.THRESHOLD and s[1] >= quality.FLOOR]
    assert 0.5 * len(rows) < len(kept) < len(rows)
    # language: the field as it is trained on what is left, evaluated word for word
    model, known = langid.fit(spark.createDataFrame(kept, "doc_id long, text string, lang string, source string")), {}
    sure = [confidence_by_force(r[1], model, known) for r in kept]
    kept = [r for r, c in zip(kept, sure) if c is not None and round(c, 4) >= langid.CONFIDENCE]
    # lines
    stripped = defaultdict(list)
    for i, t, _ in strip_by_force([(r[0], r[1], r[3]) for r in kept], linededup.MIN_SITES, linededup.MIN_CHARS):
        stripped[i].append(t)
    assert sum(len(t) for x in stripped.values() for t in x) < sum(len(r[1]) for r in kept)
    # near copies: rows of an id and fingerprint that is not its group's first go
    texts = [(i, t, None) for i, x in stripped.items() for t in x]
    nodes, first = groups_by_force(texts, simhash.K)
    lost = {n for n, r in zip(nodes, first) if n != r}
    prints = {t: tuple(np.array(f).view(np.int64).tolist()) for (_, t, _), f in zip(texts, simhash.fingerprints([t for _, t, _ in texts])[0])}
    left = [(i, t) for i, t, _ in texts if i is None or (i, *prints[t]) not in lost]
    assert 0 < len(texts) - len(left) < 40
    # packing
    want = defaultdict(list)
    for i, t in left:
        n = size_of(t)
        want[i] += [packing.WINDOW] * (n // packing.WINDOW) + [n % packing.WINDOW] * (n % packing.WINDOW > 0)
    have, bins = defaultdict(list), defaultdict(list)
    for r in got:
        have[r.doc_id].append(r.n_tokens)
        bins[r.bin_id].append(r.n_tokens)
    assert {i: sorted(x) for i, x in have.items()} == {i: sorted(x) for i, x in want.items() if x}
    sizes = [s for b in bins.values() for s in b]
    at = iter(range(len(sizes)))
    members = [[next(at) for _ in b] for b in bins.values()]
    assert len(bins) <= bfd(sizes, packing.WINDOW)[0] and max(map(sum, bins.values())) <= packing.WINDOW
    assert next(improvements(members, sizes, packing.WINDOW), None) is None


def test_stages_keep_columns_and_take_empty_tables(spark, smallest, tmp_path):
    fixture(spark, smallest, str(tmp_path))
    docs = read(spark, str(tmp_path), "documents")
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), str(tmp_path))
        assert out.count() == 0, name
        if name != "best_fit_packing":
            assert out.columns == docs.columns, name


def test_every_query_is_registered_and_runs(spark, smallest):
    found = __spark_entry__.queries()
    assert [sum(q.startswith(f"op{n}_") for q in found) for n in range(1, 11)] == [1] * 10 and "pipeline" in found
    for name, f in found.items():
        if name.startswith("op"):
            assert f(spark, smallest).count() > 0, name


def test_a_task_drops_what_other_work_remembers():
    """A worker's table of pre-tokens stays for tasks that encode and goes when another stage's task begins."""

    class Rows:
        def mapInArrow(self, run, schema):
            return run

    batch = pa.RecordBatch.from_pydict({"text": ["some words"]})
    encoder = bpe.encoder(bpe.VOCABULARY)
    encoder.count_tokens(["words that are remembered"])
    list(map_texts(Rows(), lambda rows, texts: rows, "text string", keeps=bpe.WORDS)(iter([batch])))
    assert encoder.known
    list(map_texts(Rows(), lambda rows, texts: rows, "text string")(iter([batch])))
    assert not encoder.known and not len(encoder.flat)


def test_fingerprints_of_a_slice_take_little_memory():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9000, 400)) for _ in range(900)]  # about 2 MB, a slice of map_texts
    simhash.fingerprints(texts)
    tracemalloc.start()
    simhash.fingerprints(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6


def test_line_dedup_cuts_batches_by_size(spark, monkeypatch):
    """Texts leave in slices, as they are read: what a task holds doesn't follow the rows in a batch."""
    kind = type(spark.range(1))
    seen, plain = [], kind.mapInArrow

    def spy(df, run, schema, *more, **how):
        seen.append((df, run))
        return plain(df, run, schema, *more, **how)

    monkeypatch.setattr(kind, "mapInArrow", spy)
    rows = [(i, f"line of all sites\n{i} " + "x" * 5000, f"site{i % 20}") for i in range(1000)]
    out = linededup.stage(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    df, run = seen[-1]
    batch = df.toArrow().combine_chunks().to_batches()[0]
    slices = list(run(iter([batch])))
    assert batch.num_rows == 1000 and len(slices) > 1
    got = {r["doc_id"]: r["new_text"] for part in slices for r in part.to_pylist()}
    assert got == {i: t if i == 0 else t.split("\n")[1] for i, t, _ in rows} == {r.doc_id: r.text for r in out.collect()}
