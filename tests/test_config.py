import pytest

from weftgraph import config

GOOD = {
    "specs": {"spec": ["specs/*.mdx"]},
    "code": {"src": "src/**/*.ts"},
    "coverage": [{"name": "all", "target": "spec", "boundary": "src", "edgeKinds": ["references", "depends"]}],
    "policy": [{"name": "p", "type": "forbidden", "from": {"group": "src"}, "to": {"tags": ["draft"]}}],
}


def test_good():
    made = config.load(GOOD)
    assert made.coverage["all"].edge_kinds == ("depends", "references") and made.coverage["all"].target == ("specs/*.mdx",)
    assert made.policy[0].source.group == ("src/**/*.ts",)


@pytest.mark.parametrize(
    ("change", "said"),
    [
        ({"extra": 1}, "unknown key"),
        ({"specs": {"spec": ["../x"]}}, "outside the root"),
        ({"coverage": [{"name": "a", "target": "nope", "boundary": "src"}]}, "no spec group"),
        ({"coverage": [{"name": "a", "target": "spec", "boundary": "src", "mode": "some"}]}, "none of"),
        ({"policy": [{"name": "p", "type": "forbidden", "from": {"group": "src", "tags": []}, "to": {"files": ["a"]}}]}, "exactly one"),
    ],
)
def test_bad(change, said):
    with pytest.raises(config.ConfigurationError, match=said):
        config.load(GOOD | change)
