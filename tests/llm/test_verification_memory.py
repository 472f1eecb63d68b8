"""Verification of the Jaccard join holds the sets of a few components at a time; how many must not change what is linked."""

import numpy as np
import pyarrow as pa
import pytest


def _table(rng):
    words = np.array([f"w{i}" for i in range(400)])
    rows = []
    for comp in range(12):
        base = list(rng.choice(words, int(rng.integers(1, 90))))
        for k in range(int(rng.integers(1, 6))):
            own = list(base)
            if k % 2 and len(own) > 60:
                own[-1] = f"x{k}"
            elif k % 2:
                own = list(rng.choice(words, 20))
            rows.append((comp, 100 * comp + k, int(rng.integers(1, 4)), 0, 0, " ".join(own)))
    rows.append(rows[3])  # a node that meets itself through two buckets
    rows.append((99, 9900, 1, 0, 0, None))
    comp, node, copies, side, band, text = zip(*[rows[i] for i in rng.permutation(len(rows))], strict=True)
    bands = pa.array([[n] * 36 for n in node], pa.list_(pa.int64()))
    return pa.table({"comp": comp, "node": node, "copies": copies, "side": side, "band": band, "bands": bands, "text": pa.array(text, pa.string())}), rows


def _brute(rows):
    def grams(text):
        ws = (text or "").split()
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    distinct = {(r[0], r[1]): r for r in rows}.values()
    links = {}
    for a in distinct:
        for b in distinct:
            if a[0] == b[0] and a[1] != b[1]:
                x, y = grams(a[5]), grams(b[5])
                if x and y and 5 * len(x & y) >= 4 * len(x | y):
                    links[a[1]] = links.get(a[1], 0) + b[2]
    return links


@pytest.mark.parametrize("held", [1, 700, 1 << 20])
def test_sets_held_at_a_time_change_no_link(monkeypatch, held):
    from cuelens.llm import neardup

    monkeypatch.setattr(neardup, "SET_BYTES", held)
    for seed in range(5):
        table, rows = _table(np.random.default_rng(seed))
        got = neardup._verify(table).to_pydict()
        assert dict(zip(got["node"], got["links"], strict=True)) == _brute(rows)
        assert all(root <= node and root // 100 == node // 100 for node, root in zip(got["node"], got["root"], strict=True))


def test_verifying_nothing():
    from cuelens.llm import neardup

    table, _ = _table(np.random.default_rng(0))
    assert neardup._verify(table.slice(0, 0)).num_rows == 0
