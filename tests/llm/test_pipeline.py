"""Stages of the pipeline and all of it on a small table against plain Python."""

from collections import Counter

import pytest
from test_llm import WORD, brute_hits

import corpus_pipeline
from inkstrata.llm import minhash_dedup, packing, quality, toxicity

ITEM = "which of these seven rivers flows past the old stone bridge into the sea"
INSULTS, JUNK = "you idiot you moron you idiot", "zz### qq*** " * 30
COLUMNS = "doc_id long, text string, source string, key string, n long, node long, label int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    base = [f"note {k} the river number {k} passes stone {k * 7} and light {k * 3} on day {k * 11} of its long way" for k in range(8)]
    # Repeated rows, ids that are null or stand for several texts, a passage in a long text, texts without words.
    rows = list(enumerate(base)) + [(8, base[0]), (9, base[1] + " home"), (10, f"so {ITEM} now"), (11, None), (12, ""), (13, INSULTS), (14, JUNK)]
    rows += [(3, base[3]), (3, base[3]), (None, "no id here"), (None, base[4]), (None, INSULTS), (None, JUNK), (None, f"so {ITEM} now"), (2, JUNK), (5, INSULTS), (6, f"once more {ITEM}")]
    rows += [(15, f"{' '.join(f'stone {k} river' for k in range(300))} {ITEM}"), (16, base[4]), (11, None), (12, " \n")]
    spark.createDataFrame([(k, t, "s", f"x{k}", 1, i, None) for i, (k, t) in enumerate(rows)], COLUMNS).write.parquet(f"{at}/documents.parquet")
    ids = sorted({k for k, _ in rows if k is not None})
    spark.createDataFrame([(k, int(k != 14), int(k == 13)) for k in ids], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows


def without_copies(rows):
    """One row of each component of near copies: that with the least id, null last."""
    sets = [minhash_dedup.shingle_set(t, 5) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    best = {}
    for k, (doc_id, t) in enumerate(rows):
        key = (doc_id is None, doc_id or 0, t or "")
        if sets[k] and (root[k] not in best or key < best[root[k]][0]):
            best[root[k]] = (key, k)
    chosen = {k for _, k in best.values()}
    return [r for k, r in enumerate(rows) if not sets[k] or k in chosen]


def test_stages(spark, folder, monkeypatch):
    at, rows = folder
    model = toxicity.fit([])
    good = [f"note {k} the river of stone and light on day {k % 9} of its long way" for k in range(60)]
    net = quality.fit([(t, 1) for t in good] + [("zz### qq*** " * (10 + k), 0) for k in range(60)], epochs=6)
    monkeypatch.setattr(toxicity, "train", lambda *_: model)
    monkeypatch.setattr(quality, "train", lambda *_: net)
    plain = {
        "toxicity": lambda rows: [r for r in rows if model.score(r[1]) < 0.7],
        "quality": lambda rows: [r for r in rows if quality.predict(net, [(r[1] or "").encode()])[0] >= 0.3],
        "near_duplicates": without_copies,
        "decontamination": lambda rows: [r for r in rows if not brute_hits(r[1], [(1, ITEM)])[1]],
    }
    docs = spark.read.parquet(f"{at}/documents.parquet")
    left = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        want = plain[name](rows)
        assert out.columns == docs.columns and 0 < len(want) < len(rows), name
        assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(want), name
        left = plain[name](left)
    got, encoder = corpus_pipeline.run(spark, at).collect(), packing._encoder(WORD)
    assert sum(r.length for r in got) == sum(len(encoder.ids.whole_ids(t or "")) // 4 + 1 for _, t in left)
    assert {r.doc_id for r in got} == {k for k, _ in left}


def test_stages_on_an_empty_table(spark, folder):
    at, _ = folder
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], COLUMNS), at).count() == 0, name
