"""Spelling variants: a self-join of the vocabulary's trie with active-node sets, at one inserted, deleted or replaced code point.

Words that differ by one code point and have 2 * PREFIX of them or more agree in their first PREFIX ones or in their last. So the vocabulary's trie is cut
by the first PREFIX code points, and that of the words spelled backwards by the last; each part is one task's, and no word is copied to another.

1. Within a part a trie of its words is gone down. A node's active nodes are those that its string turns into by one change at most: from its parent's
   come the parent's own (the last letter deleted), their children by the same letter (kept), by others (replaced), and the children of those with no change so far
   (inserted). Where a word ends, the active nodes at which words end are its near words. Spelled backwards, only pairs that differ in their first
   PREFIX code points are kept, as the others were found already.
2. Parts of more than MOST words are cut again below, one level further in each round and then in steps that double, until no part is larger (or
   its words are at their ends). Active nodes of other parts have used up their one change above the cut, so from there on both go down by the same letters:
   such pairs agree in the level of the change and in the whole rest, and meet by that, in groups no larger than the alphabet.
3. A word's near words are counted, and the one of largest n (ties: smallest in code-point order) is its form if its n is FACTOR times the word's or more. n
   grows by that factor along forms, so roots are reached by following them twice as far in each of a few rounds.

The vocabulary is counted in each task before it is dealt by word, so frequent words cost a row a task. Only the vocabulary's own tables are joined; followers of a
frequent root by ``common.attached``. The driver holds none of them but what ``attached`` has counted small: the other joins are hinted to shuffle.

Null and empty texts have no words. Rows that repeat an id count as texts of their own. A null doc_id changes no run. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attached, discard, materialize, shuffled, small_or_plain

LETTERS = r"A-Za-zÀ-ÿ"
PREFIX, LEAST_LENGTH, LEAST_COUNT, FACTOR, MOST = 3, 6, 5, 5, 4096
EVERY = 199


def runs(text, least: int = LEAST_LENGTH):
    """Maximal runs of letters of ``least`` or more, A to Z in lower case: array of strings."""
    plain = lambda w: F.when(w.rlike(r"[À-Þ]"), F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(w))
    return F.transform(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0)), plain)


def vocabulary(docs: DataFrame, change: bool = False, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: how often it occurs in all texts, if that is ``least_count`` or more.

    change: whether runs are changed first as the contract says: one code point is deleted where EVERY divides the checksum of id and run.
    """
    word = F.col("run")
    if change:
        h = F.crc32(F.concat(F.col("doc_id").cast("long").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
        at = (h % F.length("run")).cast("int")
        less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        word = F.when(h % EVERY == 0, less).otherwise(F.col("run"))
    each = docs.select("doc_id", F.explode(runs(F.col("text"))).alias("run")).select(word.alias("word"))
    return each.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


# ---------------------------------------------------------------- one part of the trie


def near_pairs(words: list[str]):
    """(i, j) for every two words at distance one, both ways: indices in a list of distinct words."""
    children: list[dict[str, int]] = [{}]
    ends = [-1]
    for i, word in enumerate(words):
        at = 0
        for c in word:
            to = children[at].get(c)
            if to is None:
                to = children[at][c] = len(children)
                children.append({})
                ends.append(-1)
            at = to
        ends[at] = i
    # a node's active nodes apart from itself: all with one change
    stack = [(0, set(children[0].values()))]
    while stack:
        node, active = stack.pop()
        if ends[node] >= 0:
            for other in active:
                if ends[other] >= 0:
                    yield ends[node], ends[other]
        siblings = children[node]
        for c, child in siblings.items():
            near = {to for other in active if (to := children[other].get(c)) is not None}  # kept
            near.add(node)  # deleted
            near.update(siblings.values())  # replaced
            near.update(children[child].values())  # inserted
            near.discard(child)
            stack.append((child, near))


def _joined(backwards: bool):
    """Rows (part, word, n), a part's together, to (word, near, near_n)."""

    def run(batches):
        import pandas as pd

        def pairs(held):
            cut = min(len(w) for w, _ in held)
            names = [w[::-1] if backwards else w for w, _ in held]
            shared = 0  # what all have in common needn't be gone down
            while shared < cut and len({w[shared] for w in names}) == 1:
                shared += 1
            rows = []
            for i, j in near_pairs([w[shared:] for w in names]):
                one, two = held[i][0], held[j][0]
                if not backwards or one[:PREFIX] != two[:PREFIX]:
                    rows.append((one, two, held[j][1]))
            return pd.DataFrame(rows, columns=["word", "near", "near_n"])

        part, held = None, []
        for frame in batches:
            for key, word, n in zip(frame["part"], frame["word"], frame["n"], strict=True):
                if key != part:
                    if len(held) > 1:
                        yield pairs(held)
                    part, held = key, []
                held.append((word, n))
        if len(held) > 1:
            yield pairs(held)

    return run


def _parts(words: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """spelled, word, n, part, depth: parts of ``most`` words at most, and whether any was cut below PREFIX."""
    depth, step, done = PREFIX, 1, []
    open_ = words
    while True:
        keyed = open_.withColumn("part", F.substring("spelled", 1, depth))
        large = keyed.groupBy("part").agg(F.count("*").alias("c"), F.max(F.length("spelled")).alias("longest")).filter((F.col("c") > most) & (F.col("longest") > depth))
        large = materialize(large.select("part"), "spelling-large")
        is_large = small_or_plain(large)
        done.append(keyed.join(is_large, "part", "left_anti").select(*words.columns, "part", F.length("part").alias("depth")))
        if not large.limit(1).count():
            break
        open_ = materialize(attached(keyed, large, "part").select(*words.columns), "spelling-open")
        depth, step = depth + step, step if depth < 2 * PREFIX else 2 * step
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, len(done) > 1


def _across(cut: DataFrame, backwards: bool) -> DataFrame:
    """(word, near, near_n) of pairs whose one change lies between PREFIX and the depth of their parts."""
    places = F.sequence(F.lit(PREFIX), F.col("depth") - 1)
    without = lambda i: F.concat(F.substring(F.col("spelled"), F.lit(1), i), F.substring(F.col("spelled"), i + 2, F.length("spelled")))
    letter = lambda i: F.substring(F.col("spelled"), i + 1, F.lit(1))
    deep = cut.filter(F.col("depth") > PREFIX).select("spelled", "word", "n", "depth")
    each = materialize(deep.withColumn("i", F.explode(places)).select("word", "n", "i", without(F.col("i")).alias("rest"), (letter(F.col("i")) != letter(F.col("i") + 1)).alias("last")), "spelling-cut")
    as_near = lambda d: d.select(*[F.col(c).alias({"word": "near", "n": "near_n"}.get(c, c)) for c in d.columns])
    replaced = each.select("word", "n", "i", "rest").join(shuffled(as_near(each.select("word", "n", "i", "rest"))), ["i", "rest"]).filter("word <> near").select("word", "near", "near_n")
    # the longer one without the letter at the end of a stretch of equal letters is the shorter one: once for each pair
    longer, shorter = each.filter("last").select("word", "n", "rest"), deep.select("word", "n", F.col("spelled").alias("rest"))
    inserted = longer.join(shuffled(as_near(shorter)), "rest").select("word", "near", "near_n").union(shorter.join(shuffled(as_near(longer)), "rest").select("word", "near", "near_n"))
    found = replaced.union(inserted)
    return found.filter(F.substring("word", 1, PREFIX) != F.substring("near", 1, PREFIX)) if backwards else found


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, near, near_n: all pairs at distance one, both ways. words: a written table (word, n) of words of 2 * PREFIX code points or more."""
    found = None
    for backwards in (False, True):
        named = words.select((F.reverse("word") if backwards else F.col("word")).alias("spelled"), "word", "n")
        cut, several = _parts(named, most)
        cut = materialize(cut, "spelling-parts")
        dealt = cut.select("part", "word", "n").repartition("part").sortWithinPartitions("part")
        pairs = dealt.mapInPandas(_joined(backwards), "word string, near string, near_n long")
        if several:
            pairs = pairs.union(_across(cut, backwards))
        found = pairs if found is None else found.union(pairs)
    return found


# ---------------------------------------------------------------- forms


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms of a written table (word, form) lead to."""
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        onward = materialize(onward, "spelling-onward")
        moved = attached(roots, onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = materialize(moved, "spelling-roots")
        roots = moved.select("word", "root")
        if not moved.filter("moved").limit(1).count():
            return roots


def variants(docs: DataFrame, change: bool = False, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    words = materialize(vocabulary(docs, change), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    near = materialize(near_words(words, most).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")), "spelling-near")
    of = words.join(shuffled(near), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.n")).alias("near_n"))
    larger = F.col("near_n") >= FACTOR * F.col("n")
    of = materialize(of.select("word", "n", "n_near", F.when(larger, F.col("near")).alias("form"), F.when(larger, F.col("near_n")).alias("form_n")), "spelling-forms")
    roots = _roots(of.filter("form is not null").select("word", "form"))
    discard(words, near)
    return of.join(shuffled(roots), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
