import random

import numpy as np
import pytest
from cadenza.llm import abuse

BAD = ["you are a stupid worthless {}", "nobody would miss you, {}", "i want to lick your naked {}", "ich breche dir die finger, {}", "les {} sont de la vermine", "eres basura, {}"]
GOOD = ["the {} sounds lovely in the chorus", "cut the {} at 300 Hz please", "my stupid {} limiter moans again", "das {} klingt sehr warm", "le {} reste sec", "el {} suena precioso"]
WORDS = ["piano", "drum", "cello", "viola", "synth", "organ", "bass", "horn"]


def corpus(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        s = [r.choice(GOOD).format(r.choice(WORDS)) for _ in range(r.randint(1, 5))]
        if y := r.random() < 0.3:
            s.insert(r.randint(0, len(s)), r.choice(BAD).format(r.choice(WORDS)))
        out.append((". ".join(s), int(y)))
    return out


@pytest.mark.parametrize("text,words", [("You are an I-D-I-O-T!", ["you", "are", "an", "idiot"]), ("st​upid", ["stupid"]), ("sтuріd gar.bage", ["stupid", "garbage"]), ("1d10t", ["idiot"]), ("stuuuupid", ["stupid"]), ("<p>Schwächling &amp; Größe</p>", ["schwachling", "grosse"]), ("y​ou 1d10t", ["you", "idiot"]), ("k i l l y o u", ["killyou"]), ("GrÃ¶ÃŸe", ["grosse"])])
def test_one_spelling(text, words):
    assert abuse._WORD.findall(abuse.plain(text)[1].split("\n")[0]) == words


def test_held_out_accuracy_with_noisy_labels():
    r = random.Random(1)
    train = [(t, y if r.random() > 0.05 else 1 - y) for t, y in corpus(800, 2)]
    m = abuse.fit([t for t, _ in train], np.array([y for _, y in train]))
    test = corpus(400, 3)
    p = m.score([t for t, _ in test])
    y = np.array([y for _, y in test])
    assert ((p >= 0.5) == y).mean() > 0.95
    assert abs(p.mean() - y.mean()) < 0.08


def test_what_is_learned_carries_words_no_list_has(monkeypatch):
    """Invented words: the lists know none of them, the judgements do; only one passage of a flagged text is at fault."""
    r = random.Random(6)

    def text():
        s = [r.choice(GOOD).format(r.choice(WORDS)) for _ in range(4)]
        if y := r.random() < 0.4:
            s[r.randrange(4)] = r.choice(["you zorbling {}", "go quaff a {} mate", "all {} vrents out"]).format(r.choice(WORDS))
        return ". ".join(s), int(y)

    train, test = [text() for _ in range(500)], [text() for _ in range(300)]
    m = abuse.fit([t for t, _ in train], np.array([y for _, y in train]))
    assert ((m.score([t for t, _ in test]) >= 0.5) == np.array([y for _, y in test])).mean() > 0.97


def test_features_of_a_batch_are_those_of_its_texts_alone():
    """Nothing runs over from one text or passage into the next."""
    m = abuse.fit([t for t, _ in corpus(200, 8)], np.array([y for _, y in corpus(200, 8)]))
    texts = ["you are. an idiot", None, "", "IDIOT you! k-i-l-l him\nfine day", "  \n\n ", "?!", "a", "sтuріd ﬁlm & <b>co</b>", "\ud800 odd"]
    whole = abuse.features(abuse.Passages.of(texts), m.learned)
    assert np.allclose(whole, np.vstack([abuse.features(abuse.Passages.of([t]), m.learned) for t in texts]))
    near = abuse.FEATURES.index("max_near_you")
    assert whole[0, near] == 0 and whole[3, near] == 0.5 and not whole[[1, 2, 4, 5]].any()


def test_trees_split_where_the_gain_is_greatest():
    x = np.repeat(np.arange(8.0), 50)[:, None]
    p = abuse.Trees.fit(np.hstack([np.zeros_like(x), x]), (x[:, 0] >= 3).astype(float), rounds=20).raw(np.array([[0, 2.0], [0, 3.0]]))
    assert p[0] < -2 and p[1] > 2


def test_isotonic_is_rising_and_pools():
    s, p = abuse.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1]))
    assert (np.diff(p) > 0).all() and len(s) == 3


def test_scores_of_null_empty_and_long_texts(spark):
    train = corpus(300, 4)
    m = abuse.fit([t for t, _ in train], np.array([y for _, y in train]))
    long = ". ".join(GOOD[0].format("horn") for _ in range(20_000)) + ". " + BAD[0].format("horn")
    df = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "?!", 0.5), (4, long, 0.5), (4, long, 0.5)], "doc_id bigint, text string, score double").drop("score")
    got = abuse.score(df, m, ["doc_id"]).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["flagged"] for r in got}
    assert by == {1: False, 2: False, 3: False, 4: True}


def test_labels_of_disagreeing_and_repeated_raters(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, "x", 1), (1, "x", 1), (1, "y", 0), (2, "x", 0), (2, "y", None), (3, None, 1), (9, "x", 1)], "doc_id bigint, rater string, flagged int")
    got = abuse.labelled(docs, labels)
    assert sorted(zip(got["text"].fillna(""), got["y"])) == [("", 1), ("a", 1), ("b", 0)]


def test_no_labels():
    m = abuse.fit([], np.array([]))
    assert np.isfinite(m.probability(np.zeros((2, len(abuse.FEATURES))))).all()
