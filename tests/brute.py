"""Straightforward Python answers to compare with."""

import math


def distance(a, b):
    n = min(len(a), len(b))
    return math.sqrt(sum((a[i] - b[i]) ** 2 for i in range(n)))


def near(a, b, r):
    d = distance(a, b)
    return not math.isnan(d) and d <= r


def report(points, windows, slides, radii, ks):
    """{(e, w, s, r, k): outliers} for points [(id, vector)]."""
    unit = math.gcd(*slides)
    slide = {i: i // unit for i, _ in points}
    out = {}
    for w in windows:
        m = w // unit
        for e in sorted({sl + j for sl in slide.values() for j in range(m)}):
            inside = [(i, v) for i, v in points if e - m < slide[i] <= e]
            for r in radii:
                counts = [sum(1 for j, u in inside if j != i and near(v, u, r)) for i, v in inside]
                for k in ks:
                    for s in slides:
                        if (e + 1) % (s // unit) == 0:
                            out[e, w, s, r, k] = sum(1 for c in counts if c < k)
    return out


def single(points, window, slide, radius, k):
    full = report(points, [window], [slide], [radius], [k])
    return {key[0]: n for key, n in full.items()}


def statuses(points, window, slide, radius, k):
    m = window // slide
    slide_of = {i: i // slide for i, _ in points}
    out = {}
    for i, v in points:
        for e in range(slide_of[i], slide_of[i] + m):
            others = [slide_of[j] for j, u in points if j != i and e - m < slide_of[j] <= e and near(v, u, radius)]
            late = sum(1 for sl in others if sl >= slide_of[i])
            out[e, i] = "safe_inlier" if late >= k else "inlier" if len(others) >= k else "outlier"
    return out
