import numpy as np
import pytest

from strandlake.llm import shingles, signature_tree


def components(pairs, n):
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def groups(rng, n, size):
    """Sets at all similarities: chains of edits from a few seeds."""
    seeds = [rng.integers(0, 2**63, rng.integers(1, size)).astype(np.uint64) for _ in range(4)]
    out = []
    for k in range(n):
        s = seeds[rng.integers(4)]
        change = rng.random(len(s)) < rng.choice([0, 0.02, 0.08, 0.12, 0.3])
        s = np.unique(np.concatenate([np.where(change, rng.integers(0, 2**63, len(s)).astype(np.uint64), s), rng.integers(0, 2**63, rng.integers(0, 4)).astype(np.uint64)]))
        seeds[rng.integers(4)] = s if rng.random() < 0.3 else seeds[0]
        out.append(s)
    return out


@pytest.mark.parametrize("n,size", [(2, 5), (9, 30), (70, 60), (300, 200), (60, 3000)])
def test_tree_loses_no_link(n, size):
    rng = np.random.default_rng(n)
    sets = groups(rng, n, size)
    link = lambda a, b: len(np.intersect1d(sets[a], sets[b])) * 100 >= 80 * len(np.union1d(sets[a], sets[b]))
    want = [(a, b) for a in range(n) for b in range(a + 1, n) if link(a, b)]
    sizes, bitmaps = np.array([len(s) for s in sets]), [shingles.bitmap(s) for s in sets]
    exact = lambda p, q: bool(signature_tree.enough(np.array(signature_tree.common_members(sets[p], sets[q])), sizes[p], sizes[q]))
    parts = signature_tree.Components(n)
    got = signature_tree.links(sizes, bitmaps, parts, exact)
    assert all(link(a, b) for a, b in got) and len(got) < n
    assert components(got, n) == components(want, n) == parts.labels().tolist()
    loose = signature_tree.Components(n)
    signature_tree.links(sizes, bitmaps, loose)
    label = loose.labels()
    assert all(label[a] == label[b] for a, b in want)
    side = np.arange(n) % 2 == 0
    across = signature_tree.Components(n)
    got = signature_tree.links(sizes, bitmaps, across, exact, side)
    assert components(got, n) == components([(a, b) for a, b in want if side[a] != side[b]], n)


def test_large_group_of_copies_takes_few_checks():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.unique(np.append(base, np.uint64(k))) for k in range(3000)]
    sizes, bitmaps, checks = np.array([len(s) for s in sets]), [shingles.bitmap(s) for s in sets], []
    parts = signature_tree.Components(3000)
    signature_tree.links(sizes, bitmaps, parts, lambda p, q: checks.append(1) or True)
    assert len(set(parts.labels().tolist())) == 1 and len(checks) < 3100


def test_shingles():
    s = shingles.shingles
    assert len(s(None)) == len(s(b" \n")) == 0
    assert len(s(b"a b c")) == 1 and (s(b"A B c") == s(b"a\tb c")).all() and s(b"a b c") != s(b"a b d")
    assert len(s(b"a b c d e")) == 1 and len(s(b"a b c d e f")) == 2 and len(s(b"a " * 50)) == 1
    assert len(np.intersect1d(s(b"a b c d e f g"), s(b"x b c d e f g"))) == 2
