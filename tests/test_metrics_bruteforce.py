"""Every per-list metric against a plain-Python implementation of its definition, on random lists with many
score ties (the Spark side uses RANGE frames and closed forms; this side enumerates pairs and sorts)."""

import math
import random

import pytest

from recsuite.operators import metrics as M


def _auc(y, s, strict=False):
    pos = [si for yi, si in zip(y, s) if yi == 1]
    neg = [si for yi, si in zip(y, s) if yi == 0]
    if not pos or not neg:
        return None
    tot = sum((p > n) + (0 if strict else 0.5 * (p == n)) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _order_q3(s):
    return sorted(range(len(s)), key=lambda i: (-s[i], -i))


def _order_q4(s):
    return sorted(range(len(s)), key=lambda i: (-s[i], i))


def _mrr(y, s):
    if sum(y) == 0:
        return None
    o = _order_q3(s)
    return sum(y[i] / (r + 1) for r, i in enumerate(o)) / sum(y)


def _dcg(labels_in_order, k):
    return sum((2 ** l - 1) / math.log2(r + 2) for r, l in enumerate(labels_in_order[:k]))


def _ndcg(y, s, k):
    if sum(y) == 0:
        return None
    o = _order_q3(s)
    return _dcg([y[i] for i in o], k) / _dcg(sorted(y, reverse=True), k)


def _ndcg_sklearn(y, s, k):
    """Tie-averaged DCG with linear gain, as scikit-learn computes it."""
    if len(y) <= 1:
        return None
    disc = [1 / math.log2(r + 2) if r < k else 0.0 for r in range(len(y))]
    groups = {}
    for yi, si in zip(y, s):
        groups.setdefault(si, []).append(yi)
    dcg, start = 0.0, 0
    for sc in sorted(groups, reverse=True):
        g = groups[sc]
        dcg += sum(g) / len(g) * sum(disc[start:start + len(g)])
        start += len(g)
    ideal = sum(l * disc[r] for r, l in enumerate(sorted(y, reverse=True)))
    return 0.0 if ideal == 0 else dcg / ideal


def _lrap(y, s):
    P = sum(y)
    if P == 0 or P == len(y):
        return 1.0
    tot = 0.0
    for i in range(len(y)):
        if y[i] == 1:
            ge = [j for j in range(len(y)) if s[j] >= s[i]]
            tot += sum(y[j] for j in ge) / len(ge)
    return tot / P


def _hit(y, s, k):
    return int(any(y[i] == 1 for i in _order_q4(s)[:k]))


def _recall(y, s, k):
    if sum(y) == 0:
        return None
    return sum(y[i] for i in _order_q4(s)[:k]) / sum(y)


def _logloss(y, s):
    if sum(y) in (0, len(y)):
        return None
    c = [min(max(p, 10e-12), 1 - 10e-12) for p in s]
    return -sum(yi * math.log(p) + (1 - yi) * math.log(1 - p) for yi, p in zip(y, c)) / len(y)


def _f1(y, s):
    pred = [int(p >= 0.5) for p in s]
    tp = sum(a and b for a, b in zip(y, pred))
    fp = sum((1 - a) and b for a, b in zip(y, pred))
    fn = sum(a and (1 - b) for a, b in zip(y, pred))
    return 0.0 if 2 * tp + fp + fn == 0 else 2 * tp / (2 * tp + fp + fn)


def test_list_metrics_match_definitions(spark):
    rnd = random.Random(5)
    lists = []
    for g in range(60):
        n = rnd.randint(1, 14)
        lists.append(([rnd.randint(0, 1) for _ in range(n)], [rnd.choice([0.0, 0.1, 0.2, 0.5, 0.9, 1.0]) for _ in range(n)]))
    data = [(g, p, y, s) for g, (ys, ss) in enumerate(lists) for p, (y, s) in enumerate(zip(ys, ss))]
    df = spark.createDataFrame(data, "impression_id int, pos int, label int, score double")
    got = {r.impression_id: r for r in M.list_metrics(df, ks=(3, 5)).collect()}
    for g, (y, s) in enumerate(lists):
        r = got[g]
        expect = {
            "auc": _auc(y, s), "auc_strict": _auc(y, s, True), "mrr": _mrr(y, s), "lrap": _lrap(y, s),
            "logloss": _logloss(y, s), "f1": _f1(y, s),
            "rmse": math.sqrt(sum((a - b) ** 2 for a, b in zip(y, s)) / len(y)),
            "accuracy": sum(int(a == int(b >= 0.5)) for a, b in zip(y, s)) / len(y),
        }
        for k in (3, 5):
            expect[f"ndcg_{k}"] = _ndcg(y, s, k)
            expect[f"ndcg_sk_{k}"] = _ndcg_sklearn(y, s, k)
            expect[f"hit_{k}"] = _hit(y, s, k)
            expect[f"recall_{k}"] = _recall(y, s, k)
        for name, want in expect.items():
            have = r[name]
            if want is None:
                assert have is None, (g, name, y, s, have)
            else:
                assert have == pytest.approx(want, abs=1e-9), (g, name, y, s, have, want)
