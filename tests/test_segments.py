import random
import re
from collections import Counter

from veriframe.functions.text import MORE_STOP_WORDS, STOP_WORDS
from veriframe.operators import segments


def tokens(text, stop, least):
    return [w for w in re.findall(r"(?<![A-Za-z0-9_])[a-z0-9]+(?![A-Za-z0-9_])", text.lower()) if w not in stop and len(w) >= least]


def cosine(a, b):
    g, h = (Counter(s.lower()[i : i + 3] for i in range(len(s) - 2)) for s in (a, b))
    return sum(g[k] * h[k] for k in g) / (sum(v * v for v in g.values()) * sum(v * v for v in h.values())) ** 0.5 if g and h else 0


def direction(a, b):
    name = lambda s: re.sub("[^a-z0-9]+", " ", s.lower()).strip()
    if len(a) < 80 or len(b) < 80:
        return 0.0
    if len(name(a)) >= 80 and name(a) in name(b):
        return 1.0
    x, y = tokens(a, MORE_STOP_WORDS, 3), tokens(b, MORE_STOP_WORDS, 3)
    if len(x) < 12 or len(y) < 12:
        return 0.0
    pairs = lambda t: set(zip(t, t[1:], strict=False))
    return min(1.0, 0.42 * len(set(x) & set(y)) / len(set(x)) + 0.43 * len(pairs(x) & pairs(y)) / len(pairs(x)) + 0.15 * cosine(a, b))


def by_hand(source, target):
    """Every window on its own."""
    words, n = source.split(), len(target.split())
    step, best = max(6, min(48, n // 5 or 6)), None
    want = set(tokens(target, MORE_STOP_WORDS, 3))
    for size in dict.fromkeys(max(24, min(len(words), int(n * m + 0.5))) for m in (0.72, 0.90, 1.08, 1.30, 1.58, 1.95)):
        starts = list(range(0, len(words) - size + 1, step))
        for start in [*starts, *([len(words) - size] if len(words) - size not in starts else [])]:
            window = " ".join(words[start : start + size])
            if len(window) < 80:
                continue
            a, b = set(tokens(target, STOP_WORDS, 1)), set(tokens(window, STOP_WORDS, 1))
            share = len(want & set(tokens(window, MORE_STOP_WORDS, 3))) / len(want)
            score = share * 0.38 + direction(target, window) * 0.22 + direction(window, target) * 0.07 + len(a & b) / len(a | b) * 0.13 + cosine(target, window) * 0.10 + min(len(target), len(window)) / max(len(target), len(window)) * 0.10
            if best is None or round(score, 12) > round(best[0], 12):
                best = (score, start, size, share)
    return best


def text(rng, n):
    return " ".join(rng.choice(["the", "of", f"word{rng.randrange(60)}", f"well-known{rng.randrange(9)}", f"Term{rng.randrange(40)},", "x_y", "é", "it's"]) for _ in range(n))


def test_the_best_window_is_that_of_all_windows():
    rng = random.Random(2)
    for _ in range(12):
        target = text(rng, rng.randrange(14, 60))
        kept = [w for w in target.split() if rng.random() > 0.2][1:]
        source = f"{text(rng, rng.randrange(60, 200))} {' '.join(kept)} {text(rng, rng.randrange(60, 200))}"
        got, want = segments.best_window(source, target), by_hand(source, target)
        assert (got["start"], got["size"], got["score"], got["tokens"]) == (want[1], want[2], round(want[0], 9), round(want[3], 9))


def test_windows_cost_no_more_for_longer_texts_in_total():
    """Values that enter and leave: each at most once a size."""
    rng = random.Random(5)
    moves = Counter()

    class Counted(segments.Bag):
        def move(self, low, high):
            moves["in"] += max(0, high - self.high)
            moves["out"] += max(0, low - self.low)
            super().move(low, high)

    kept, segments.Bag = segments.Bag, Counted
    try:
        source = text(rng, 6000)
        segments.best_window(source, text(rng, 300))
    finally:
        segments.Bag = kept
    assert moves["out"] <= moves["in"] <= 6 * (len(source) + 3 * 2 * 6000)


def test_outcomes(spark):
    rng = random.Random(9)
    target = text(rng, 40)
    long = text(rng, 300)
    rows = [
        (1, f"{long} {target.upper()} {long}", target), (2, long + " " + " ".join(target.split()[4:36]) + " " + long, target), (3, "nothing of this kind " * 100, target),
        (4, target, target + " and more"), (5, None, target), (6, long, None), (7, "short", "short"), (8, long, "too few different words " * 5),
    ]
    got = {r["k"]: r["kind"] for r in segments.best_windows(spark.createDataFrame(rows, "k int, source string, target string"), ["k"]).collect()}
    assert got == {1: "EXACT", 2: "WINDOW", 3: "NONE"}
    assert segments.best_windows(spark.createDataFrame([], "k int, source string, target string"), ["k"]).collect() == []


def test_the_best_segment_takes_either_direction(spark):
    rng = random.Random(4)
    a, b = text(rng, 60), text(rng, 60)
    pages = spark.createDataFrame([(1, 0, text(rng, 60)), (1, 1, a + " " + text(rng, 200)), (1, 2, b), (1, 3, b), (2, 0, "short")], "doc_id int, page int, text string")
    targets = spark.createDataFrame([("a", a), ("b", b)], "id string, text string")
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "doc_id int, target_id string")
    got = {(r["doc_id"], r["target_id"]): (r["page"], r["score"]) for r in segments.best_segments(pairs, pages, targets).collect()}
    assert got == {(1, "a"): (1, 1.0), (1, "b"): (2, 1.0), (2, "a"): (0, 0.0)}
