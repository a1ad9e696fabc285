import pytest

EXTRA = "component_id string, node string, bucket string, score string, position string, key string, row string, spans string, _id string, _text_key string, _spans string, _position string, hit_id string, own_key string"


@pytest.fixture
def make(spark):
    """Documents with columns whose names clash with what operators use inside."""

    def documents(rows):
        kind = "doc_id long, text string, lang string, source string, n_chars long"
        full = [(*(tuple(row) + (None, None))[:2], "en", row[2] if len(row) > 2 else "s", len(row[1] or ""), *["x"] * 14) for row in rows]
        return spark.createDataFrame(full, f"{kind}, {EXTRA}")

    return documents


def roots(nodes, pairs):
    """Smallest node of each node's component."""
    up = {node: node for node in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {node: find(node) for node in nodes}
