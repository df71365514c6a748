"""The stemmer on published pairs, ranks against a plain search over all stretches."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from tessera.functions import english, text
from tessera.operators import search

#: Words and stems from the published description and sample vocabulary of the Porter2 rules.
PAIRS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consistency": "consist", "consistently": "consist", "consolation": "consol", "consolatory": "consolatori", "consolidate": "consolid",
    "consoling": "consol", "consonant": "conson", "knack": "knack", "knackeries": "knackeri", "knavish": "knavish", "kneaded": "knead", "kneeling": "kneel", "knightly": "knight", "knitting": "knit", "knocked": "knock", "knots": "knot", "hopping": "hop", "hoping": "hope",
    "happy": "happi", "cry": "cri", "by": "by", "say": "say", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "this": "this", "ties": "tie", "cries": "cri", "luxuriated": "luxuri", "hopped": "hop", "national": "nation", "relational": "relat", "sensational": "sensat", "generously": "generous",
    "communication": "communic", "skies": "sky", "news": "news", "inning": "inning", "innings": "inning", "exceed": "exceed", "adjustable": "adjust", "adoption": "adopt", "formative": "format", "controlling": "control", "rate": "rate", "cease": "ceas", "beauty": "beauti", "yes": "yes", "enjoyed": "enjoy",
}


@pytest.mark.parametrize("word", sorted(PAIRS))
def test_stems(word):
    assert english.stem(word) == PAIRS[word]


def covers(places):
    """All stretches from a place to a place that hold every lexeme and hold no shorter such stretch, by trying all."""
    line = sorted((p, k) for k, own in enumerate(places) for p in own)
    whole = [(a, b) for a in range(len(line)) for b in range(a, len(line)) if {k for _, k in line[a : b + 1]} == set(range(len(places)))]
    least = [(a, b) for a, b in whole if not any((c, d) != (a, b) and a <= c and d <= b for c, d in whole)]
    return sum(0.1 / (1 + (line[b][0] - line[a][0] - (b - a))) for a, b in least)


def test_cover_density_against_all_stretches():
    rng = random.Random(2)
    for _ in range(300):
        spots = rng.sample(range(1, 60), rng.randrange(3, 12))
        places = [[] for _ in range(rng.randrange(1, 4))]
        for p in sorted(spots):
            rng.choice(places).append(p)
        if all(places):
            assert english.cover_density(places) == pytest.approx(covers(places))


def test_nearness():
    near = lambda d: math.sqrt(0.01 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
    assert english.nearness([[3], [5]]) == pytest.approx(near(2))
    pairs = [abs(a - b) for a, b in itertools.product([1, 9], [4])]
    assert english.nearness([[1, 9], [4]]) == pytest.approx(1 - math.prod(1 - near(d) for d in pairs))
    assert english.nearness([[1]]) == pytest.approx(0.0607927)
    assert english.nearness([[1], [500]]) < 1e-15


def test_lexemes_and_full_text(spark):
    assert english.lexeme_places("The quick foxes, and a quick FOX") == {"quick": [2, 6], "fox": [3, 7]}
    rows = [(1, "Running engines of the world"), (2, "engine noise while it runs and runs"), (3, "world"), (4, None), (5, "")]
    docs = search.search_docs(spark.createDataFrame(rows, "cluster_id long, body string"), "cluster_id", "body")
    found = {r.cluster_id: r.rank for r in search.full_text(docs, "cluster_id", "engines RUN").collect()}
    # places 1 and 2 without a word between them; engine at 1, runs at 5: three between
    assert found == {1: pytest.approx(0.1), 2: pytest.approx(0.1 / 4)}
    assert search.full_text(docs, "cluster_id", "of the").count() == 0


def test_identifiers():
    assert text.identifier_of(" arXiv:2401.12345v2 ") == ("arxiv", "2401.12345v2")
    assert text.identifier_of("https://doi.org/10.1038/S41") == ("doi", "10.1038/s41")
    assert text.identifier_of("pmid: 12") == ("pmid", "12") and text.identifier_of("1234567") == ("pmid", "1234567") and text.identifier_of("12") == (None, "")
