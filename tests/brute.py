"""Token-by-token statements of the model, for small inputs."""

from collections import defaultdict


def em(bitext, rounds, null=0, growth=False):
    """``bitext``: list of (src, tgt). Returns {(e, f): p}."""
    count = defaultdict(float)
    for src, tgt in bitext:
        for f in tgt:
            for e in [*src, null]:
                count[e, f] += 1
    table = normal(count)
    for k in range(1, rounds + 1):
        n_null = k + 1 if growth else 1
        count = defaultdict(float)
        for src, tgt in bitext:
            words = [*src, *[null] * n_null]
            for f in tgt:
                weight = [table[e, f] * (0.2 if e == null else 0.8 / (len(words) + 1)) for e in words]
                for e, w in zip(words, weight):
                    count[e, f] += w / sum(weight)
        table = normal(count)
    return table


def normal(count):
    sums = defaultdict(float)
    for (e, _), n in count.items():
        sums[e] += n
    return {(e, f): n / sums[e] for (e, f), n in count.items()}


def best_links(src, tgt, table, null=0):
    links = set()
    for f_pos, f in enumerate(tgt):
        best, at = table.get((null, f), 0.0) * 0.2, -1
        for e_pos, e in enumerate(src):
            prob = table.get((e, f), 0.0) * (0.8 / (len(src) + 1))
            if prob > best:
                best, at = prob, e_pos
        if at >= 0:
            links.add((at, f_pos))
    return links


def scores(sentences, proposed, gold):
    """``sentences``: {sid: (n_src, n_tgt)}; link sets of (sid, e, f), gold with sure flag."""
    a_s = a_p = a = s = 0
    for sid, (n_src, n_tgt) in sentences.items():
        for f in range(n_tgt):
            for e in range(n_src):
                is_a = (sid, e, f) in proposed
                sure = gold.get((sid, e, f)) is True
                possible = (sid, e, f) in gold
                a_s += is_a and sure
                a_p += is_a and possible
                a += is_a
                s += sure
    return a_s, a_p, a, s
