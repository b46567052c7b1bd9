"""Levenshtein automata against brute force, contexts, and held-out accuracy."""

import math
import random
import zlib

import pytest

from linkgraph.llm import toxicity as tox


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def test_automaton_equals_brute_force():
    rng = random.Random(5)
    terms = ["idiot", "moron", "scum", "disgusting", "worthless", "trash", "trashy", "éclair"]
    trie = tox.FuzzyTrie(terms)
    words = [t for t in terms]
    for _ in range(6000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "t", "é", "Z"])
        words.append("".join(w))
    for w in words:
        near = [(distance(w, t), t) for t in terms]
        near = [(d, t) for d, t in near if d <= tox.FuzzyTrie.edits(t)]
        assert trie.match(w) == (min(near) if near else None), w


def test_misspelled_and_context():
    matcher = tox.Matcher(tox.Model())
    score = lambda t: tox.probability(matcher.model, matcher.hits(t))
    assert score("you are an idiot") >= 0.3 > score("you are an author")
    assert score("you are an idiott, w0rthless") >= 0.3
    quoted = score('they wrote "an idiot" in the report')
    assert score("you idiot went to the report at the end") > score("an idiot went to the report at the end") > quoted
    assert 0 <= score("") < 0.3


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    out = {r.doc_id: r for r in tox.toxicity_digest(docs, labels).collect()}
    assert len(out) == docs.count()
    for i, r in out.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(r.toxic, out[r.doc_id].predicted) for r in labels.collect() if out[r.doc_id].held_out]
    caught = sum(p for t, p in held if t) / sum(t for t, _ in held)
    wrong = sum(p for t, p in held if not t) / sum(1 - t for t, _ in held)
    assert caught >= 0.85 and wrong <= 0.01


def test_held_out_labels_have_no_effect(spark, tables):
    docs, labels = tables
    docs, labels = docs.where("doc_id < 1500"), labels.where("doc_id < 1500")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - toxic, toxic) toxic")
    a = {r.doc_id: r.score for r in tox.toxicity_digest(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in tox.toxicity_digest(docs, flipped).collect()}


def test_odd_rows(docs, tables):
    df = docs([(1, None, 0.5), (1, "", 0.5), (None, "you idiot", None), (2, "word " * 200_000 + "idiot you idiot", 1.0)], "doc_id long, text string, score double")
    labels = tables[1].where("false")
    out = tox.toxicity_digest(df, labels).collect()
    assert {(r.doc_id, r.predicted) for r in out} == {(1, 0), (None, 1), (2, 1)} and len(out) == 4
    assert not any(r.held_out is None for r in out)
    kept = tox.drop_toxic(df, labels)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1]
    assert tox.toxicity_digest(docs([]), labels).count() == 0


def test_every_strong_word_gets_fuzzy_matches(docs):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(4))
    insults, plain = [word() for _ in range(150)], [word() for _ in range(400)]
    rows, labels = [], []
    for i in range(2400):
        toxic = i % 2
        rows.append((i, " ".join(rng.sample(plain, 20) + toxic * rng.sample(insults, 10))))
        labels.append((i, toxic))
    model = tox.fit(docs(rows), docs(labels, "doc_id long, toxic int"))
    strong = [w for w in insults if model.words.get(w, 0.0) >= tox.STRONG]
    assert len(strong) > 100 and set(strong) <= set(model.fuzzy)
    matcher = tox.Matcher(model)
    for w in strong:
        assert matcher.hits("qx" + w[1:])[2] or matcher.hits(w[:1] + "q" + w[1:])[2]


def test_misspelled_terms_are_caught_by_the_automaton_alone(docs, monkeypatch):
    """Held-out texts misspell each learned term; clean ones hold words of like letters."""
    rng = random.Random(13)
    word = lambda n: "".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(n))
    insults, plain = [word(4) for _ in range(40)], [word(3) for _ in range(400)]
    rows, labels, held = [], [], {}
    for i in range(1600):
        toxic, text = i % 2, rng.sample(plain, 25)
        if tox.held_out(i):
            held[i] = toxic
            text += [w[:k] + "xq"[k % 2] + w[k + 1 :] for w in rng.sample(insults, 3 * toxic) for k in (rng.randint(0, 3),)]
        else:
            text += rng.sample(insults, 3 * toxic)
            labels.append((i, toxic))
        rows.append((i, " ".join(rng.sample(text, len(text)))))
    model = tox.fit(docs(rows), docs(labels, "doc_id long, toxic int"))
    score = lambda: {i: tox.probability(model, matcher.hits(t)) >= tox.THRESHOLD for i, t in rows if i in held}
    matcher = tox.Matcher(model)
    got = score()
    assert sum(got[i] for i, y in held.items() if y) >= 0.95 * sum(held.values()) and not any(got[i] for i, y in held.items() if not y)
    monkeypatch.setattr(tox.FuzzyTrie, "match", lambda self, word: None)
    matcher = tox.Matcher(model)
    assert sum(score().values()) < 0.05 * sum(held.values())


def plain_score(model, text):
    """The score as the definition has it: every term's distance worked out, every window walked."""
    low = text.lower()
    spans = [m.span() for m in tox.WORD.finditer(low)]
    words = [low[a:b] for a, b in spans]
    exact, fuzzy = [], []
    for i, w in enumerate(words):
        weight, term = model.words.get(w, 0.0), ""
        if not weight:
            near = [(distance(w, t), t) for t in model.fuzzy if model.words.get(t, 0) >= tox.STRONG and abs(len(t) - len(w)) < 3] if len(w) > 3 else []
            near = [(d, t) for d, t in near if d <= (0 if len(t) < 5 else 1 if len(t) < 9 else 2)]
            if near:
                d, term = min(near)
                weight = model.words[term] * 0.8**d
            else:
                weight = max([model.stems.get(w[:n], 0.0) for n in range(len(w) + 1)])
        if not weight:
            continue
        lo, hi = max(0, i - 5), min(len(words), i + 6)
        before, after = low[max(0, spans[lo][0] - 1) : spans[i][0]], low[spans[i][1] : spans[hi - 1][1] + 1]
        if len(tox.QUOTES.findall(before)) == 1 == len(tox.QUOTES.findall(after)):
            weight *= 0.4
        if tox.REPORTING & set(words[lo:i] + words[i + 1 : hi]):
            weight *= 0.7
        if tox.ADDRESS & set(words[max(0, i - 2) : i + 3]):
            weight *= 1.15
        (fuzzy if term else exact).append((weight, term) if term else weight)
    x = [1.0, *tox.features(len(words), exact, fuzzy, model.trust)]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(model.coefficients, x, strict=True))))


def test_scores_equal_the_definition(tables):
    docs, labels = tables
    model = tox.fit(docs, labels)
    matcher = tox.Matcher(model)
    texts = ['He said "you idiot" to them, a lozer.', 'stupidd "trash" word', "ídiot idiots", ""] + [r.text or "" for r in docs.where("length(text) < 1500 and doc_id % 40 = 3").collect()]
    for t in texts:
        assert abs(tox.probability(model, matcher.hits(t)) - plain_score(model, t)) < 1e-9, t[:80]


def test_automaton_is_emptied_when_full(monkeypatch):
    words = ["".join(p) for p in zip("abcdefghij" * 20, "klmnopqrst" * 20, *["uvwxyzabcdefg" * 16] * 6)][:200]
    trie, small = tox.FuzzyTrie(words), tox.FuzzyTrie(words)
    spoilt = [w[:2] + "é" + w[3:] for w in words]
    want = [trie.match(w) for w in spoilt]
    monkeypatch.setattr(tox, "PAIRS", 500)
    assert all(want) and [small.match(w) for w in spoilt] == want
    assert small.pairs < trie.pairs


def test_stems_come_out_of_the_automaton():
    """A stem takes any ending, and one edit where it is long; whole terms go first."""
    trie = tox.FuzzyTrie(["moron", "stupid*", "disgusti*", "disgu*"], {"disgusti*": 2.0, "disgu*": 3.0})
    cases = {"moronx": (1, "moron"), "stupidly": (0, "stupid*"), "stupydly": None, "disgusting": (0, "disgu*"), "disghsting": (1, "disgusti*"), "disgunt": (0, "disgu*"), "stupi": None, "mo": None}
    assert {w: trie.match(w) for w in cases} == cases
    rng = random.Random(6)
    stems = ["achkeite", "worthles", "patheti", "idiot", "loser"]
    trie = tox.FuzzyTrie([f"{t}*" for t in stems], {f"{t}*": 1.0 for t in stems})
    for _ in range(4000):
        w = list(rng.choice(stems) + rng.choice(["", "s", "ness", "ly"]))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "t", "h"])
        w = "".join(w)
        near = [(min(distance(w[:n], t) for n in range(len(w) + 1)), f"{t}*") for t in stems]
        near = [(d, t) for d, t in near if d <= (1 if len(t) > 7 else 0)]
        assert trie.match(w) == (min(near) if near else None), w


def test_the_automaton_decides(tables, monkeypatch):
    """Without it a third of the toxic held-out texts get another prediction, and the ranking is worse."""
    docs, labels = tables
    model = tox.fit(docs, labels)
    rows = [r for r in docs.join(labels, "doc_id").collect() if tox.held_out(r.doc_id)]
    score = lambda: [tox.probability(model, matcher.hits(r.text or "")) for r in rows]
    matcher = tox.Matcher(model)
    with_it = score()
    monkeypatch.setattr(tox.FuzzyTrie, "match", lambda self, word: None)
    matcher = tox.Matcher(model)
    without = score()
    ranked = lambda p: sum((a > b) + (a == b) / 2 for a, r in zip(p, rows) if r.toxic for b, s in zip(p, rows) if not s.toxic)  # noqa: E731, B905
    toxic = sum(r.toxic for r in rows)
    assert sum((a >= 0.3) != (b >= 0.3) for a, b in zip(with_it, without, strict=True)) >= 0.2 * toxic
    assert ranked(with_it) >= 0.97 * toxic * (len(rows) - toxic) and ranked(with_it) > ranked(without)
