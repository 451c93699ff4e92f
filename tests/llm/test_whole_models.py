"""Subject models against the models of all counts."""

from __future__ import annotations

import numpy as np
import pandas as pd

from lexgraph.llm import subjects
from lexgraph.runtime import table


def test_no_weighty_ngram_is_left_out(spark, data_dir, monkeypatch):
    # a bound on n-grams by frequency must not come back: with one this small nearly all would be lost
    monkeypatch.setattr(subjects, "MAX_NGRAMS", 50, raising=False)
    docs, samples = table(spark, data_dir, "documents"), table(spark, data_dir, "subject_samples")
    names = sorted({r.subject for r in samples.collect()})
    got = subjects.train_models(subjects.tokenised(docs, "doc_id", "text"), samples, "text", "subject", names, rounds=1)
    rows = samples.collect()
    own = subjects.sample_counts([r.text for r in rows], [r.subject for r in rows], names)
    first = subjects.Counts.of(len(names) + 1, own).models(names)
    t = subjects.tokens_of([r.text for r in docs.where("text IS NOT NULL").select("text").collect()])
    taught = subjects.count_ngrams(t, subjects.teach_labels(first.scores(t), len(names), t.text))
    want = subjects.Counts.of(len(names) + 1, pd.concat((own, taught))).models(names)
    assert len(want.bi) > 50
    assert np.array_equal(got.uni, want.uni) and np.array_equal(got.bi, want.bi)
    assert np.allclose(got.ratio, want.ratio, atol=1e-5)


def test_tokens_keep_texts_and_sentences():
    texts = ["Unu doi. Trei 4 5!\n\nȘase", None, "", "șapte"]
    t = subjects.tokens_of(texts)
    again = subjects.Tokens.unpack(t.pack())
    assert t.of_text.tolist() == [6, 0, 0, 1] and t.of_sentence.tolist() == [2, 3, 1, 1] and t.text.tolist() == [0, 0, 0, 3]
    assert all(np.array_equal(getattr(t, f), getattr(again, f)) for f in ("words", "of_sentence", "of_text"))
    assert t.words[3] == t.words[4] and len(t.pairs(t.sentence)[0]) == 3
    assert len(subjects.tokens_of([]).text) == 0


def test_held_out_counts_are_those_of_the_rest():
    texts, labels = ["alfa beta alfa", "gama beta", "alfa delta"], ["a", "b", "a"]
    whole = subjects.Counts.of(3, subjects.sample_counts(texts, labels, ["a", "b"]))
    less = whole.less(subjects.sample_counts(texts[:1], labels[:1], ["a", "b"]))
    rest = subjects.Counts.of(3, subjects.sample_counts(texts[1:], labels[1:], ["a", "b"]))
    seen = less.uni_n.sum(axis=1) > 0
    assert np.array_equal(less.uni[seen], rest.uni) and np.array_equal(less.uni_n[seen], rest.uni_n) and np.array_equal(less.total, rest.total)


def test_a_sentence_may_deal_with_several_subjects():
    names = ["a", "b"]
    rng = np.random.default_rng(1)
    words = {"a": ["alfa", "beta", "gama"], "b": ["unu", "doi", "trei"]}
    texts = [" ".join(rng.choice(words[x], 8)).capitalize() + "." for x in names for _ in range(30)]
    labels = ["a"] * 30 + ["b"] * 30
    m = subjects.calibrated(subjects.Counts.of(3, subjects.sample_counts(texts, labels, names)), texts, labels, names)
    t = subjects.tokens_of([texts[0], texts[40], "Nimic despre acestea."])
    assert m.dealt(t).tolist() == [[True, False], [False, True], [False, False]]
    m.accept[:] = -99
    assert m.dealt(t).all() and subjects.document_areas(m, t, 0.25) == [names] * 3


def test_a_model_of_many_shards_is_the_whole(spark, data_dir, monkeypatch):
    # the driver held the whole model several times over; now no step may hold more than a shard of it
    docs, samples, subs = table(spark, data_dir, "documents"), table(spark, data_dir, "subject_samples"), table(spark, data_dir, "subjects")
    names = sorted({r.subject for r in samples.collect()})
    blocks = subjects.tokenised(docs, "doc_id", "text")
    (whole,), accept = subjects.train_shards(blocks, samples, "text", "subject", names)
    areas = sorted(subjects.find_areas(docs, "doc_id", "text", samples, subs).collect())
    one = whole.value
    most = len(one.ratio) // 5
    largest = []
    init = subjects.SubjectModels.__post_init__
    monkeypatch.setattr(subjects, "SHARD_ROWS", most)
    told, again = subjects.train_shards(blocks, samples, "text", "subject", names)
    parts = [b.value for b in told]
    assert len(parts) > 5 and max(len(m.ratio) for m in parts) < 2 * most and np.array_equal(accept, again)
    assert sorted(np.concatenate([m.uni for m in parts])) == one.uni.tolist() and sorted(np.concatenate([m.bi for m in parts])) == one.bi.tolist()
    t = subjects.tokens_of([r.text for r in docs.select("text").collect()])
    assert np.allclose(sum(m.scores(t) for m in parts), one.scores(t), atol=1e-4)
    # what the driver builds beside the shards are models of the samples' n-grams only
    monkeypatch.setattr(subjects.SubjectModels, "__post_init__", lambda m: (largest.append(len(m.ratio)), init(m))[1])
    assert sorted(subjects.find_areas(docs, "doc_id", "text", samples, subs).collect()) == areas
    rows = samples.collect()
    own = subjects.sample_counts([r.text for r in rows], [r.subject for r in rows], names)
    assert max(largest) <= max(2 * most, len(own.drop_duplicates(["pair", "hash"])))
