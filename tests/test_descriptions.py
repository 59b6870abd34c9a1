"""Texts that stand for conditions."""

from gristmill.functions.conditions import DESCRIBED, describe


def test_describe():
    leaf = {"pointer": "/payload/secret", "equals": "do not show"}
    assert describe(leaf) == "/payload/secret equals"
    assert describe({"pointer": "", "present": False}) == '"" present=false'
    assert describe({"first_of": ["/a", "/b"], "length": {"gte": 3}}) == "first_of(/a, /b) length gte"
    assert describe({"all": [leaf, {"any": [{"literal": 1, "in": [1]}, {"not": {"pointer": "/a", "empty": True}}]}]}) == "all(/payload/secret equals; any(literal in; not(/a empty=true)))"
    text = describe({"any": [{"pointer": "/" + "x" * 60, "gt": k} for k in range(20)]})
    assert len(text) == DESCRIBED and text.endswith("...")
