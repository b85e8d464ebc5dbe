import random

import numpy as np
import pytest
from revstrand.config import AssemblyConfig, ReadConfig, Refine, Signature, Sketch, read_config
from revstrand.operators import align
from revstrand.operators import kernels as K


def dna(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def rc(s):
    return s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


def mutate(s, rate, seed, indel=False):
    r, out = random.Random(seed), []
    for c in s:
        if r.random() < rate:
            k = r.choice(["sub", "ins", "del"]) if indel else "sub"
            out += {"sub": [r.choice([x for x in "ACGT" if x != c])], "ins": [c, r.choice("ACGT")], "del": []}[k]
        else:
            out.append(c)
    return "".join(out)


def naive_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def naive_minimizers(s, k, w):
    code, got = {"A": 0, "C": 1, "T": 2, "G": 3}, set()
    val = []
    for i in range(len(s) - k + 1):
        m = s[i : i + k]
        v = None if set(m) - set("ACGT") else sum(code[c] * 4 ** (k - 1 - j) for j, c in enumerate(m))
        val.append(v)
    for i in range(len(val) - w + 1):
        c = [(v % 2147483647 * 48271 % 2147483647, j, v) for j, v in enumerate(val[i : i + w], i) if v is not None]
        if c:
            got.add(min(c)[1:])
    return sorted(got)


A = K.as_array
CFG = ReadConfig(end_guard=500)


@pytest.mark.parametrize("seed", range(6))
def test_minimizers_against_definition(seed):
    s = dna(300, seed)
    s = s[:100] + "NN" + s[102:] if seed % 2 else s
    pos, val = K.minimizers(A(s), Sketch(9, 7))
    assert list(zip(pos.tolist(), val.tolist())) == naive_minimizers(s, 9, 7)


def test_minimizers_of_short_and_canonical():
    assert len(K.minimizers(A("ACGT"), Sketch(9, 7))[0]) == 0
    s = dna(200, 3)
    one, two = (np.sort(K.minimizers(A(x), Sketch(9, 7, False))[1]) for x in (s, rc(s)))
    assert len(np.intersect1d(one, two)) > 0.8 * len(np.unique(one))


def test_revcomp_codes_and_lower_case():
    assert K.revcomp(A("ACGTRYKMBDHVSWNx")).tobytes() == b"NNWSBDHVKMRYACGT"
    assert K.kmer_codes(A("acgt"), 2).tolist() == K.kmer_codes(A("ACGT"), 2).tolist()


def test_edit_distance_exhaustive_and_banded():
    import itertools

    words = ["".join(p) for n in range(4) for p in itertools.product("AC", repeat=n)]
    for a in words:
        for b in words:
            d = naive_edit(a, b)
            for band in range(4):
                assert K.edit_distance(A(a), A(b), band) == (d if d <= band else band + 1), (a, b, band)
    for n in (64, 200, 513):
        a = dna(n, n)
        b = mutate(a, 0.1, n, True)
        assert K.edit_distance(A(a), A(b), n) == naive_edit(a, b)


def test_clean_foldback_is_exact():
    a = dna(1504, 1)
    s = A(a + rc(a))
    f = K.detect(s, CFG)
    assert abs(f.split - 1504) <= 20  # the coarse split is off by about k / 2
    r = K.refine(s, f, CFG)
    assert r.split == 1504 and r.identity == 1.0 and r.gap == 0


@pytest.mark.parametrize("gap", [300, 400, 2000])
def test_gap_is_estimated(gap):
    a = dna(1500, 2)
    s = A(a + dna(gap, 9) + rc(a))
    r = K.refine(s, K.detect(s, CFG), CFG)
    assert abs(r.gap - gap) <= 40 and r.identity >= 0.9 and abs(r.split - (1500 + gap // 2)) <= 120


def test_random_reads_have_no_call():
    assert all(K.detect(A(dna(4000, s)), CFG) is None for s in range(100, 130))
    assert K.detect(A("ACGT"), CFG) is None and K.detect(A(""), CFG) is None and K.detect(A("N" * 500), CFG) is None


def test_noise_and_ont_indels():
    a = dna(2000, 5)
    s = A(a + rc(mutate(a, 0.05, 6)))
    assert K.refine(s, K.detect(s, CFG), CFG).identity >= 0.9
    ont = ReadConfig(sketch=Sketch(11, 11), end_guard=500, refine=Refine(mode="ont", arm=400, window=40))
    s = A(a + rc(mutate(a, 0.04, 7, True)))
    r = K.refine(s, K.detect(s, ont), ont)
    assert r is not None and r.identity > 0.88 and abs(r.split - 2000) <= 45


def test_chain_is_strict_prefix_minima():
    r = np.random.default_rng(0)
    for _ in range(200):
        n = 30
        x, y = r.integers(0, 50, n), r.integers(0, 50, n)
        pts, last, want = sorted(zip(x, -y)), 10**9, 0
        for _, m in pts:
            if -m < last:
                want, last = want + 1, -m
        cfg = ReadConfig(min_matches=1, min_arm=0, end_guard=0)
        got = K._fold(x, y, 10**6, cfg)
        assert got.matches == want


def test_repetitive_values_are_dropped():
    s = A("ACGTTGCA" * 200)
    j = K.self_join(s, ReadConfig(sketch=Sketch(5, 3), min_matches=1))
    assert j is not None and len(j[0]) == 0


def test_signatures_agree_and_differ():
    a = dna(1500, 11)
    sig = []
    for left in (a, a, dna(1500, 12)):
        s = A(left + rc(left))
        f = K.detect(s, CFG)
        sig.append(K.signature(s, f, K.refine(s, f, CFG).split, CFG))
    assert sig[0] == sig[1] != sig[2]
    assert K.signature_local(np.array([1]), np.array([1]), 1, Signature(take=2)) is None
    assert K.signature_flank(A(a), 100, 17, 21, Signature(flank=200)) is None
    assert len({K.signature_flank(A(dna(700, s)), 350, 17, 21, Signature(flank=300, take=8)) for s in range(200)}) == 200


def test_recursive_cut_goes_inwards():
    inner = dna(3000, 21)
    inner = inner + rc(inner)
    s = A(inner + rc(inner))
    f = K.detect(s, CFG)
    r = K.refine(s, f, CFG)
    assert abs(K.recursive_cut(s, f, r, CFG, set()) - 3000) <= 5
    assert abs(K.recursive_cut(s, f, r, ReadConfig(end_guard=500, max_depth=1), set()) - 6000) <= 5
    assert K.recursive_cut(s, f, r, CFG, {K.signature(s, f, r.split, CFG)}) == len(s)
    assert K.recursive_cut(s, f, r, ReadConfig(end_guard=500, max_depth=0), set()) == len(s)


def test_low_identity_stays_uncut():
    a = dna(2000, 31)
    s = A(a + rc(a))
    f = K.detect(s, CFG)
    r = K.refine(s, f, CFG)
    r.identity = 0.3
    assert K.recursive_cut(s, f, r, CFG, set()) == len(s)


def test_arm_identity_on_planted():
    a = dna(2500, 41)
    for rate in (0.0, 0.02, 0.1):
        b = mutate(a, rate, 5, True)
        got = K.arm_identity(A(a), A(rc(b)), 0.65)
        d = naive_edit(a[:600], mutate(a[:600], rate, 5, True)) / 600
        assert abs(got - (1 - d)) < 0.03
    assert K.arm_identity(A(""), A("A"), 0.65) is None
    assert K.arm_identity(A(dna(400, 1)), A(dna(400, 2)), 0.65) < 0.65


def test_topk_and_bounds():
    a, b = dna(1200, 51), dna(900, 52)
    s = A(a + rc(a) + dna(3000, 53) + b + rc(b))
    cfg = AssemblyConfig(min_matches=10, min_arm=200)
    hits = K.detect_topk(s, cfg, 4)
    assert sorted(round(h.split, -2) for h in hits[:2]) == [1200, 6300] and len(K.detect_topk(s, cfg, 1)) == 1
    f = hits[0]
    la0, la1, ra0, ra1, kept = K.trimmed_bounds(f.p1, f.p2, f.split, len(s), cfg)
    assert la0 < la1 <= ra0 + 40 and ra0 < ra1 and kept > 0
    assert K.trimmed_bounds(f.p1, f.p2, 10**6, 10**7, cfg) is None


def test_lanes_against_one_pair_at_a_time():
    r = np.random.default_rng(5)
    for t in range(25):
        a = A(dna(120, t) + "N" * int(r.integers(0, 5)) + rc(dna(120, t))[int(r.integers(0, 9)) :])
        left, right = r.integers(1, len(a), 15), r.integers(0, len(a), 15)
        size = np.array([r.integers(0, min(x, len(a) - y) + 1) for x, y in zip(left, right)])
        band = int(r.integers(1, 70))
        want = [K.edit_distance(a[x - n : x], K.revcomp(a[y : y + n]), band) for x, y, n in zip(left, right, size)]
        assert K.lane_edits(a, left, right, size, band).tolist() == want


def full_matrix(a, b):
    """(score, matches, columns) of the best global alignment, by the whole matrix of three states."""
    none, n, m = (-(10**9), 0, 0), len(a), len(b)
    plus = lambda t, s, e: (t[0] + s, t[1] + e, t[2] - 1)
    h, e, f = ([[none] * (m + 1) for _ in range(n + 1)] for _ in range(3))
    for i in range(n + 1):
        for j in range(m + 1):
            best = [(0, 0, 0)] if i == j == 0 else []
            if i:
                e[i][j] = max(plus(h[i - 1][j], -5, 0), plus(e[i - 1][j], -1, 0))
                best.append(e[i][j])
            if j:
                f[i][j] = max(plus(h[i][j - 1], -5, 0), plus(f[i][j - 1], -1, 0))
                best.append(f[i][j])
            if i and j:
                best.append(plus(h[i - 1][j - 1], 1, 1) if a[i - 1] == b[j - 1] else plus(h[i - 1][j - 1], -1, 0))
            h[i][j] = max(best)
    score, same, columns = h[n][m]
    return score, same, -columns


def random_pairs(n, longest, seed):
    r = random.Random(seed)
    for _ in range(n):
        a = [r.choice("ACGT") for _ in range(r.randint(1, longest))]
        b = list(a)
        if r.random() < 0.3:  # unlike
            b = [r.choice("AACGT") for _ in range(r.randint(1, longest))]
        for _ in range(r.randint(0, 8)):
            p, what = r.randrange(len(b) + 1), r.random()
            if what < 0.4 and p < len(b):
                b[p] = r.choice("ACGT")
            elif what < 0.7:
                b[p:p] = [r.choice("ACGT") for _ in range(r.randint(1, 12))]
            elif len(b) > 14:
                del b[p : p + r.randint(1, 12)]
        yield A("".join(a)), A("".join(b))


def test_lanes_equal_the_full_matrix():
    pairs = list(random_pairs(250, 50, 3))
    assert align.align(pairs) == [full_matrix(a.tolist(), b.tolist()) for a, b in pairs]


def test_a_band_is_proven_not_guessed():
    """The best path lies 60 diagonals away, and narrow bands agree on a worse one."""
    shift, body = dna(60, 1), dna(300, 2)
    a, b = A(shift + body), A(body + shift)
    got = align.align([(a, b)])[0]
    assert got == align.align([(b, a)])[0] and got[1] >= 300 and got[2] == 420
    narrow = [align._decoded(int(align._lanes([(a, b)], w)[0])) for w in (4, 8)]
    assert narrow[0][0] < got[0] and all(align.sure_band(align.penalty(x[0], len(a), len(b)), len(a), len(b)) > 8 for x in narrow)
    assert all(align.penalty(full_matrix(x.tolist(), y.tolist())[0], len(x), len(y)) >= 0 for x, y in random_pairs(20, 20, 5))


def test_long_arms_are_aligned(monkeypatch):
    x = dna(3000, 70)
    y = rc(x[:1000] + dna(1500, 71) + x[1000:])  # an offset beyond any narrow band
    got = K.arm_identity(A(x), A(y), 0.0)
    assert abs(got - 3000 / 4500) < 0.02
    pairs = list(random_pairs(40, 60, 9))
    assert [K._long_pair(a, b, 2) for a, b in pairs] == align.align(pairs)
    monkeypatch.setattr(align, "LONG", 1)
    assert K.arm_identity(A(x[:700]), A(rc(x[:300] + "ACGTACG" + x[300:700])), 0.0) == 700 / 707


def test_trimmed_and_extreme_bounds_by_sorting():
    a = A(dna(900, 80) + dna(60, 81) + rc(dna(900, 80)))
    cfg = AssemblyConfig(min_matches=10, min_arm=200)
    f = K.detect(a, cfg)
    low, high = sorted(min(p) for p in zip(f.p1.tolist(), f.p2.tolist())), sorted(max(p) for p in zip(f.p1.tolist(), f.p2.tolist()))
    near = [(p, q) for p, q in zip(f.p1.tolist(), f.p2.tolist()) if abs(p + q - 2 * f.split) <= 480]
    left, right = sorted(map(min, near)), sorted(map(max, near))
    at = lambda v, q: v[int(q * (len(v) - 1) + 0.5)]
    assert K.trimmed_bounds(f.p1, f.p2, f.split, len(a), cfg) == (at(left, 0.1), at(left, 0.9) + 17, at(right, 0.1), min(at(right, 0.9) + 17, len(a)), len(near))
    assert K.minmax_bounds(f.p1, f.p2, len(a), 17) == (low[0], low[-1] + 17, high[0], min(high[-1] + 17, len(a)))


def test_config_precedence():
    assert read_config().min_matches == 20 and read_config("strict").sig == Signature(800, 10, 0)
    c = read_config("permissive", "ont", min_support=7, w=15)
    assert (c.sketch.k, c.sketch.w, c.min_support, c.max_depth) == (11, 15, 7, 8)
    f = read_config("strict", "ont", fairness=True, min_matches=99)
    assert (f.min_matches, f.sketch.k, f.refine.mode, f.max_depth, f.refine.window) == (20, 17, "hifi", 1, 200)
    with pytest.raises(ValueError):
        read_config("none")


def test_edits_of_all_splits_and_all_shifts_at_once(monkeypatch):
    """Arms with a random gap: many edits at every split. Lanes whose work is the square of the edits must not be asked for them."""
    rng = np.random.default_rng(3)
    a = np.concatenate([x := rng.choice(np.frombuffer(b"ACGT", np.uint8), 260), rng.choice(np.frombuffer(b"ACGTN", np.uint8), 240), K.revcomp(x)])
    first, count, arm = 330, 90, 300
    want = [K.edit_distance(a[s - arm : s], K.revcomp(a[s : s + arm]), arm) for s in range(first, first + count)]
    assert K.arm_edits(a, first, count, arm).tolist() == want
    most, seen = [], K.lane_edits
    monkeypatch.setattr(K, "lane_edits", lambda a, l, r, n, band, enough=None: most.append(band) or seen(a, l, r, n, band, enough))
    assert K._first_best(a, np.arange(first, first + count), arm, 200) == (min(want), int(np.argmin(want))) and max(most) <= K.FEW_EDITS
    assert K._first_best(a, np.arange(first, first + count), arm, min(want) - 1)[0] == min(want)
    one, two = x[:200], np.concatenate([x[:90], x[95:200], x[:5]])
    for band in (3, 200):
        got = K.prefix_edits(one, two, band, np.array([201]))
        assert got.tolist() == [min(K.edit_distance(one[:n], two[:n], 200), band + 1) for n in range(201)]


def test_bands_are_proven_without_widening_them_to_the_gaps_bound(monkeypatch):
    """A tenth of other bases: gaps alone prove only a band of hundreds of diagonals; what mismatches outside cost proves a small one."""
    from revstrand.operators import align

    rng = np.random.default_rng(8)
    letters = np.frombuffer(b"ACGT", np.uint8)
    pairs = []
    for shift in (0, 0, 3, -7, 25):
        a = rng.choice(letters, 900)
        b = np.where(rng.random(900) < 0.1, rng.choice(letters, 900), a)
        pairs.append((a, np.concatenate([b[:300], rng.choice(letters, max(shift, 0)), b[300 + max(-shift, 0) :]])))
    a = np.frombuffer(b"AC" * 300, np.uint8)
    pairs += [(a, np.concatenate([a[3:], a[:9]])), (a, np.where(rng.random(600) < 0.2, 65, a).astype(np.uint8))]
    bands, lanes = [], align._lanes
    monkeypatch.setattr(align, "_lanes", lambda some, band: bands.append(band) or lanes(some, band))
    got = align.align(pairs[:5])
    assert max(bands) <= 4 * align.BOUNDED
    got += align.align(pairs[5:])
    assert got == [align._decoded(int(lanes([p], max(map(len, p)))[0])) for p in pairs]
    for a, b in pairs:  # the bound of paths outside isn't above the best path that is kept out of the band
        full = align.penalty(align._decoded(int(lanes([(a, b)], max(len(a), len(b)))[0]))[0], len(a), len(b))
        inside = align.penalty(align._decoded(int(lanes([(a, b)], 2)[0]))[0], len(a), len(b))
        reach = max(len(a), len(b))
        assert full == inside or align.outside([(a, b)], 2, reach)[0] <= full
        assert align.outside([(a, b)], 2, reach)[0] == align.outside([(a, b)], 2, reach, 20_000)[0]


def test_splits_are_left_out_only_by_bounds(monkeypatch):
    """The first best split is that of all splits, of sequences by themselves and together, and few splits are aligned."""
    rng = np.random.default_rng(6)
    letters = np.frombuffer(b"ACGT", np.uint8)
    todo, want = [], []
    for t in range(60):
        arm, around = int(rng.integers(20, 120)), int(rng.integers(1, 30))
        x = rng.choice(letters[: 2 if t % 5 == 0 else 4], arm + around + 12)
        y = K.revcomp(x)
        y = np.where(rng.random(len(y)) < (0, 0.02, 0.1, 0.3)[t % 4], rng.choice(letters, len(y)), y).astype(np.uint8)
        at = int(rng.integers(0, len(y)))
        a = np.concatenate([x, rng.choice(letters, int(rng.integers(0, 40))), y[:at], rng.choice(letters, t % 3), y[at:]])
        mid = min(max((len(a) + int(rng.integers(-8, 8))) // 2, arm + around), len(a) - arm - around)
        splits = np.arange(mid - around, mid + around + 1)
        edits = K.arm_edits(a, int(splits[0]), len(splits), arm)
        for band in (arm, max(arm // 4, 1)):
            todo.append((a, splits, arm, band))
            want.append((int(edits.min()), int(edits.argmin())) if edits.min() <= band else band + 1)
    alone, together = [K._first_best(*x) for x in todo], K._answered([K._best_split(*x) for x in todo])
    assert alone == together and [g if isinstance(w, tuple) else g[0] for g, w in zip(alone, want)] == want
    # arms with a random gap, as many edits as there are splits: a twentieth of the splits' cells
    arm = rng.choice(letters, 600)
    a = np.concatenate([arm, rng.choice(letters, 400), K.revcomp(arm)])
    cells, seen = [], K.free_steps
    monkeypatch.setattr(K, "free_steps", lambda asked, half: cells.append(sum(x.size for x, _ in asked) * (2 * half + 1)) or seen(asked, half))
    monkeypatch.setattr(K, "EQUAL_CELLS", 1 << 12)
    got = K._first_best(a, np.arange(700, 901), 650, 200)
    assert got == (int((e := K.arm_edits(a, 700, 201, 650)).min()), int(e.argmin())) and sum(cells) * 20 < 201 * 650 * 650


def test_narrow_bands_hold_every_best_path(monkeypatch):
    """Bands that are known before any alignment are as good as the whole matrix, also where repeats make other diagonals cheap."""
    from revstrand.operators import align

    rng = np.random.default_rng(12)
    letters = np.frombuffer(b"ACGT", np.uint8)
    changed = lambda a, share: np.where(rng.random(len(a)) < share, rng.choice(letters, len(a)), a).astype(np.uint8)
    pairs = []
    for share in (0.05, 0.2, 0.3):
        a = rng.choice(letters, 700)
        unit = np.tile(rng.choice(letters, 23), 20)
        mixed = np.concatenate([a[:200], np.tile(rng.choice(letters, 3), 40), a[200:400]])
        for x in (a, unit, mixed):
            b = changed(x, share)
            pairs += [(x, b), (x[9:], b[: len(b) - 17]), (np.concatenate([x, a[:40]]), np.concatenate([a[30:45], b])), (x, np.concatenate([b[:150], b[171:]]))]
    whole = [align._decoded(int(align._lanes([p], max(map(len, p)))[0])) for p in pairs]
    bands = [align.narrow_band(*p) for p in pairs]
    known = [(p, b, w) for p, b, w in zip(pairs, bands, whole) if b is not None]
    assert len(known) > len(pairs) // 3 and all(align._decoded(int(align._lanes([p], b)[0])) == w for p, b, w in known)
    assert align.align(pairs) == whole
    # arms as long as those of contigs, a fifth of their bases changed: one alignment in a small band, nothing outside is followed
    a = rng.choice(letters, 6000)
    seen, lanes = [], align._lanes
    monkeypatch.setattr(align, "_lanes", lambda some, band: seen.append((len(some), band)) or lanes(some, band))
    monkeypatch.setattr(align, "outside", None)
    got = align.align([(a, changed(a, 0.25)), (a, changed(a, 0.1)), (a[20:], changed(a, 0.1)[:-35])])
    assert sum(n for n, _ in seen) == 3 and max(b for _, b in seen) <= 64 and all(x[1] > 4800 for x in got)


def test_edits_of_many_pairs_in_step():
    rng = np.random.default_rng(12)
    letters, pairs = np.frombuffer(b"ACGT", np.uint8), [(b"", b""), (b"", b"AC"), (b"ACGTA", b""), (b"A", b"C")]
    for _ in range(150):
        a = rng.choice(letters, int(rng.integers(1, 90))).tobytes()
        b = bytearray(a)
        for _ in range(int(rng.integers(0, 9))):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 3))] = rng.choice(letters, int(rng.integers(0, 3))).tobytes()
        pairs.append((a, bytes(b)))
    for band in (0, 3, 10):
        assert K.pair_edits(pairs, band) == [min(naive_edit(a, b), band + 1) for a, b in pairs]
