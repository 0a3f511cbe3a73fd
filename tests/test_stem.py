"""English word forms; expected stems are those that the algorithm's description gives."""

import pytest

from agorafold.functions import stem
from agorafold.plans import api

FORMS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist", "consistency": "consist", "consistent": "consist",
    "consistently": "consist", "consolation": "consol", "consolatory": "consolatori", "console": "consol", "consonant": "conson", "conspicuous": "conspicu", "conspicuously": "conspicu", "constable": "constabl",
    "constancy": "constanc", "constant": "constant", "knack": "knack", "knackeries": "knackeri", "knave": "knave", "knaves": "knave", "knavish": "knavish", "kneaded": "knead", "kneading": "knead", "knee": "knee",
    "knees": "knee", "kneel": "kneel", "kneeling": "kneel", "knew": "knew", "knightly": "knight", "knocked": "knock", "knots": "knot", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "ties": "tie",
    "cries": "cri", "cry": "cri", "by": "by", "say": "say", "luxuriated": "luxuri", "hopping": "hop", "hoping": "hope", "hopped": "hop", "relational": "relat", "generate": "generat", "general": "general",
    "generously": "generous", "communities": "communiti", "dying": "die", "skies": "sky", "proceed": "proceed", "exceeding": "exceed", "sensational": "sensat", "photography": "photographi", "photographers": "photograph", "cats": "cat", "dog's": "dog",
}


@pytest.mark.parametrize(("word", "form"), FORMS.items())
def test_stems(word, form):
    assert stem.stem(word) == form


def test_lexemes():
    assert stem.lexemes("The Cats and a dog's running, runs!") == ["cat", "dog", "run"] and stem.lexemes(None) == [] == stem.lexemes("of the and")
    assert stem.lexemes("\u0444\u043e\u0442\u043e \u00e9t\u00e9 2024") == ["2024", "\u00e9t\u00e9", "\u0444\u043e\u0442\u043e"]


def test_community_search_by_word_forms(spark):
    call = lambda query: {r["title"] for r in api.call("bridge.list_communities", spark, "/root/testdata/sf0.001", {"query": query, "last_rank": 0}).collect()}
    assert call("Nations 7") == {"NATION_7"} == call("the nation of 7") and call("the") == set() == call("nation notional")
    assert call("europe") and call("7 europe") <= {"NATION_7"} and not call("europe") & call("asia")
