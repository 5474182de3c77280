import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tandem.llm import variants
from tandem.llm.common import read_table
from tests.llm.conftest import EDGES, documents

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows, every=97, letters=5, times=3):
    total = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= letters:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= times}


def near(words):
    """By deletions: independent of the operator's grams."""
    holes = {}
    for w in words:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1:]), []).append(w)
    out = {w: set() for w in words}
    for (a, b), same in holes.items():
        for x in same:
            out[x].update(y for y in same if y != x)
            if a + b in out:
                out[x].add(a + b)
                out[a + b].add(x)
    return out


def brute(counts):
    rows, form = {}, {}
    for w, others in near(counts).items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
        rows[w] = len(others)
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], rows[w], counts[form[w]] if form[w] else None))
    return sorted(out)


def result(docs, **options):
    return sorted(map(tuple, variants.group(docs, **options).collect()))


def spelled(n, seed, letters="aeinrst", known=40):
    """Texts of words and of words with one or two letters changed."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 11))) for _ in range(known)]
    def word():
        w = pool[int(known * rng.random() ** 2)]
        for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
            i = rng.randrange(len(w))
            w = rng.choice((w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]))
        return w
    return [(rng.choice((i, i, None)), " ".join(word() for _ in range(rng.randint(0, 80)))) for i in range(n)]


@pytest.mark.parametrize("seed, letters, most, every", [
    (1, "aeinrst", 50_000, 97), (2, "aeinrst", 60, 5), (3, "ab", 30, 7), (4, "aéß^$", 20, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, letters, most, every):
    monkeypatch.setattr(variants, "LEAST_FREQUENT", 2)
    rows = spelled(150, seed, letters)
    docs = documents(spark, rows)
    assert result(docs, every=every, most=most, times=2) == brute(counted(rows, every, times=2))


def test_edges(edges, nothing):
    assert result(edges) == brute(counted(EDGES))
    assert result(edges, times=1, letters=2, every=2) == brute(counted(EDGES, 2, 2, 1))
    assert variants.group(nothing).count() == 0


def test_a_given_table(spark):
    from tandem.llm.queries import QUERIES

    rows = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    want = brute(counted(rows))
    assert sorted(map(tuple, QUERIES["op11_spelling_variants"](spark, "/root/testdata/sf0.001").collect())) == want
    assert sum(w[1] is not None for w in want) > 20


def test_forms_are_followed_to_the_end(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)], "word string, form string")
    assert {r.root for r in variants.follow(forms).collect()} == {"w9"}


def one_edit(word, letters):
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in letters)
    for i in range(len(word)):
        yield word[:i] + word[i + 1:]
        yield from (word[:i] + c + word[i + 1:] for c in letters)


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_bound_of_affected_grams_holds_for_every_edit(longest):
    rng = random.Random(longest)
    letters = "abc"
    counts = {}
    for size in range(2, longest + 1):  # closed under prefixes, as counts are
        for g in {"".join(rng.choice(letters + "^$") for _ in range(size)) for _ in range(60)}:
            if size == 2 or g[:-1] in counts:
                counts[g] = rng.randint(5, 50)
    grams = variants.Grams(counts, longest)
    for _ in range(150):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
        cut = grams.cut(f"^{word}$")
        shared = len(cut) - grams.affected(f"^{word}$", cut)
        own = Counter(f"^{word}$"[a:b] for a, b in cut)
        for other in one_edit(word, letters):
            theirs = Counter(f"^{other}$"[a:b] for a, b in grams.cut(f"^{other}$"))
            assert sum((own & theirs).values()) >= shared


def test_frequent_grams_are_closed_under_prefixes_and_bounded(spark):
    rng = random.Random(6)
    made = {"".join(rng.choice("abcd") for _ in range(7)) for _ in range(900)}
    words = spark.createDataFrame([(w,) for w in made], "word string")
    counts = variants.gram_counts(words, 40)
    every = Counter(f"^{w}$"[i:i + size] for w in made for size in (2, 3, 4) for i in range(len(w) + 3 - size))
    least = max(variants.LEAST_FREQUENT, sum(len(w) + 2 for w in made) // 40)
    assert counts == {g: n for g, n in every.items() if n > least}
    assert counts and all(len(g) == 2 or g[:-1] in counts for g in counts)
    assert all(sum(len(g) == size for g in counts) <= 40 for size in (2, 3, 4))


def test_few_lists_hold_a_word(spark):
    rows = read_table(spark, "/root/testdata/sf0.001", "documents")
    words = variants.count_words(rows)
    counts = variants.gram_counts(words)
    lists = variants.list_words(words, "test", spark.sparkContext.broadcast(counts), variants.LONG)
    held = lists.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("l")).agg(
        F.avg(F.col("n") / F.col("l")).alias("share")).first()["share"]
    assert held < 0.9
