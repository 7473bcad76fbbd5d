"""Variant spellings of names typed by people, linked to the entity they refer to.

Noisy-channel attribution.  Names are first freed of encoding damage and look-alike characters, folded and parsed into
surname and given-name tokens.  Distinct parsed names meet through their surname tokens and the tokens one deletion
away; a channel says by which changes - abbreviation, typo, nickname, order, a part left out - one can come from the
other.  Which short forms stand for which names, and how likely each change is, is learned from spellings that take
turns at one institution.  Within a context - the institution, or a co-author the name would not meet by chance - each
spelling is attached to the candidate canonical form with the highest posterior (log likelihood plus log frequency); a
spelling has one parent, so an initial never merges two people whose full names differ.  Mentions that no context
places go to the entity that holds most of the posterior of their name, where it holds enough of it.

Scale: work is on distinct names and distinct (name, institution) nodes, so a hot name is one row; nothing is
collected; pairs are only made between different spellings of one entity.

Defined results: null and empty names belong to no entity; repeated deliveries count once; null or empty affiliations
are "no institution"; texts of any length are parsed whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entiforge.llm.encoding import restore_names
from entiforge.llm.visual import LOOK_ALIKE, name_forms
from entiforge.operators.components import connected_components
from entiforge.operators.hotkeys import hot_keys, salted
from entiforge.plans.lineage import cut

# Particles and suffixes that come and go, transliteration of Cyrillic letters, and letters that
# decomposition leaves whole.
PARTICLES = set("van von der de la du den del di da dos das le el al bin ter".split())
SUFFIXES = set("jr sr ii iii iv".split())
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n",
    "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "",
    "э": "e", "ю": "yu", "я": "ya", "ґ": "g", "є": "ie", "і": "i", "ї": "i",
}
WHOLE = {"ø": "o", "ł": "l", "æ": "ae", "œ": "oe", "ß": "ss", "ð": "d", "þ": "th", "đ": "d", "ı": "i"}

_TO_LATIN = str.maketrans({a: f for f, alikes in LOOK_ALIKE.items() for a in alikes})
_TO_CYRILLIC = str.maketrans({f: a for f, alikes in LOOK_ALIKE.items() for a in reversed(alikes) if "Ѐ" <= a <= "ӿ" and f.isascii() and f.isalpha() and a not in "ӏӀ"})
_LOOKS_LATIN = {a for alikes in LOOK_ALIKE.values() for a in alikes}


@lru_cache(1 << 16)
def fold(form: str) -> str:
    """Lower-case ASCII of a name's visual form; a name counts as Cyrillic when letters without a Latin twin say so."""
    native = sum("Ѐ" <= c <= "ӿ" and c not in _LOOKS_LATIN for c in form)
    if native:
        strict_latin = sum(c.isascii() and c.isalpha() and c not in "ABCEHIJKMOPSTXYacehijopsxykmt" for c in form)
        if native > strict_latin:
            form = form.translate(_TO_CYRILLIC)
    else:
        form = form.translate(_TO_LATIN)
    out = []
    for c in unicodedata.normalize("NFC", form).lower():
        out.append(CYRILLIC.get(c) if c in CYRILLIC else WHOLE.get(c, c))
    t = unicodedata.normalize("NFKD", "".join(out))
    return "".join(c for c in t if not unicodedata.combining(c))


def _tokens(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text) if w]


def parse(form: str) -> tuple[list[str], list[str], bool]:
    """``(surname tokens, given tokens, sure)``; without a comma the tokens all stand in the second list, one word
    each with hyphens kept, and the order is settled by token statistics."""
    parts = fold(form).split(",")
    given = [p for p in parts[1:] if p.strip(" .") not in SUFFIXES]
    if len(parts) > 1:
        sur = _tokens(parts[0])
        kept = [w for w in sur if w not in PARTICLES and len(w) > 1] or sur
        return kept, [w for w in _tokens(" ".join(given)) if w not in SUFFIXES], True
    ws = [w.strip(".'") for w in parts[0].split(" ")]
    flat: list[str] = []
    for w in ws:
        bare = w.replace("'", " ").replace(".", " ").split()
        flat += [b for b in bare if b not in PARTICLES and b not in SUFFIXES]
    return [], flat, False


@lru_cache(1 << 18)
def skeleton(token: str) -> str:
    """Surname token without what typists and scanners confuse in a regular way."""
    t = token.replace("0", "o").replace("1", "l").replace("rn", "m").replace("ks", "x").replace("ck", "k").replace("ph", "f").replace("y", "i").replace("j", "i").replace("w", "v")
    return re.sub(r"(.)\1+", r"\1", t)


def _near(a: str, b: str) -> bool:
    """One insertion, deletion, substitution or swap of neighbours apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[i + 1 :] == short[i:]


#: Ways in which one spelling comes from another; how likely each is, is counted in the corpus (:func:`learned_costs`).
KINDS = ("initial", "joined", "nick", "typo", "shape", "middle", "part", "bare", "order")


class Channel:
    """What was done to one name to give another, as kinds of changes; ``forms`` are learned short forms,
    short -> formal names."""

    def __init__(self, forms: dict[str, tuple[str, ...]]):
        self.forms = forms
        self.token = lru_cache(1 << 18)(self._token)

    def written_out(self, token: str) -> set[str]:
        return {token, *self.forms.get(token, ())}

    def _token(self, a: str, b: str) -> tuple[str, ...] | None:
        if a == b:
            return ()
        fa, fb = self.written_out(a), self.written_out(b)
        if len(a) == 1 or len(b) == 1:
            return ("initial",) if {f[0] for f in fa} & {f[0] for f in fb} else None
        if fa & fb:
            return ("nick",)
        sa, sb = skeleton(a), skeleton(b)
        if sa == sb:
            return ("shape",)
        if min(len(a), len(b)) >= 3 and (_near(a, b) or min(len(a), len(b)) > 4 and _near(sa, sb)):
            return ("typo",)
        if any(min(len(f), len(g)) > 3 and _near(f, g) for f in fa for g in fb):
            return ("nick", "typo")
        return None

    def _aligned(self, a: list[str], b: list[str]) -> tuple[str, ...] | None:
        kinds: tuple[str, ...] = ()
        for x, y in zip(a, b):
            k = self.token(x, y)
            if k is None:
                return None
            kinds += k
        return kinds + ("middle",) * abs(len(a) - len(b))

    def given(self, a: str, b: str) -> tuple[str, ...] | None:
        """Changes between two given-name parts (tokens separated by blanks)."""
        if a == b:
            return ()
        x, y = a.split(), b.split()
        if not x or not y:
            return ("bare",)
        best = self._aligned(x, y)
        for p, q in ((x, y), (y, x)):
            # joined initials: "jp" for "jean pierre"
            if len(p) == 1 and 2 <= len(p[0]) <= 3 and len(q) >= 2:
                k = self._aligned(list(p[0]), q)
                if k is not None and (best is None or len(k) + 1 < len(best)):
                    best = ("joined",)
        return best

    def surname(self, a: str, b: str) -> tuple[str, ...] | None:
        if a == b:
            return ()
        x, y = a.split(), b.split()
        if len(x) == len(y):
            each = [self.token(p, q) if len(p) > 1 and len(q) > 1 else (() if p == q else None) for p, q in zip(x, y)]
            if None not in each:
                return tuple(k for kinds in each for k in kinds)
            return ("order",) if sorted(x) == sorted(y) else None
        short, long = (x, y) if len(x) < len(y) else (y, x)
        kinds: tuple[str, ...] = ("part",)
        for p in short:
            fits = [k for q in long if len(q) > 1 and (k := self.token(p, q)) is not None]
            if not fits:
                return None
            kinds += min(fits, key=len)
        return kinds

    def changes(self, sur_a: str, given_a: str, sur_b: str, given_b: str) -> tuple[str, ...] | None:
        s = self.surname(sur_a, sur_b)
        g = self.given(given_a, given_b) if s is not None else None
        return None if g is None else s + g

    def meeting_keys(self, given: str) -> list[str]:
        """Keys of which two given-name parts share one whenever :meth:`given` finds changes between them: the initial
        of each form, and what is left of the first token when its first letter is the one mistyped."""
        if not given:
            return [""]
        first = given.split()[0]
        keys = {skeleton(f)[0] for f in self.written_out(first)} | {f[0] for f in self.written_out(first)}
        for f in self.written_out(first):
            if len(f) >= 3:
                keys |= {"~" + f, "~" + f[1:], "~" + "".join(sorted(f[:2])) + f[2:]}
        return sorted(keys)


def _deletions(col: Column) -> Column:
    """Hashes of a token and, from three letters on, of the token less any one letter."""
    n = F.length(col)
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.concat(F.substring(col, F.lit(1), i - 1), F.substring(col, i + 1, n))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(col)), F.when(n >= 3, less).otherwise(F.array().cast("array<bigint>"))))


def parsed_names(rows: DataFrame, column: str = "author_name") -> DataFrame:
    """``(column, sur, given, key)`` for each distinct non-empty name: repaired, unified, folded and parsed."""
    repaired = cut(restore_names(rows.where(F.length(F.trim(column)) > 0), column).select(column, "restored"), "repaired")
    forms = name_forms(repaired, "restored")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [parse(f) for f in pdf["visual_form"]]
            yield pd.DataFrame({"restored": pdf["restored"], "sur": [g[0] for g in got], "given": [g[1] for g in got], "sure": [g[2] for g in got]})

    parsed = cut(forms.mapInPandas(run, "restored string, sur array<string>, given array<string>, sure boolean"), "parsed")
    tidy = F.filter("sur", lambda w: F.length(w) > 0)
    known = parsed.where("sure")
    stats = (
        known.select(F.explode("sur").alias("w"), F.lit(0).alias("g"), F.lit(1).alias("s"))
        .union(known.select(F.explode("given").alias("w"), F.lit(1).alias("g"), F.lit(0).alias("s")))
        .where("length(w) > 1")
        .groupBy("w")
        .agg(F.sum("g").alias("g"), F.sum("s").alias("s"))
    )
    # without a comma: the word that is least often a given name is the surname, initials never, the last one on ties
    loose = parsed.where("not sure and size(given) > 0").select("restored", F.posexplode("given").alias("pos", "word"))
    rated = loose.withColumn("w", F.regexp_replace("word", "-.*$", "")).join(stats, "w", "left")
    ratio = F.when(F.length(F.regexp_replace("word", "[^a-z]", "")) <= 2, F.lit(1e9)).otherwise((F.coalesce("g", F.lit(0)) + 0.1) / (F.coalesce("s", F.lit(0)) + 0.1))
    ratio = F.when(F.col("word").contains("-") & (F.coalesce("g", F.lit(0)) == 0), ratio * 0.01).otherwise(ratio)
    chosen = rated.groupBy("restored").agg(F.min(F.struct(ratio.alias("r"), (-F.col("pos")).alias("p"))).alias("m"), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("ws"))
    settled = chosen.select(
        "restored",
        F.split(F.element_at(F.col("ws.word"), (1 - F.col("m.p")).cast("int")), "-").alias("sur"),
        F.flatten(F.transform(F.filter("ws", lambda x: x["pos"] != -F.col("m.p")), lambda x: F.split(x["word"], "-"))).alias("given"),
    )
    both = known.select("restored", tidy.alias("sur"), "given").unionByName(settled).where("size(sur) > 0")
    keyed = both.select("restored", F.array_join("sur", " ").alias("sur"), F.array_join(F.filter("given", lambda w: F.length(w) > 0), " ").alias("given"))
    return repaired.join(keyed, "restored").select(column, "sur", "given", F.xxhash64("sur", "given").alias("key"))


def learned_forms(nodes: DataFrame, keys: DataFrame, least: int = 2, lift: float = 10.0, size: int = 1 << 16) -> dict[str, tuple[str, ...]]:
    """``short form -> formal names`` from the corpus: first given names that take turns under one surname at one
    institution.

    Only places with exactly two given names are counted, where it is plain which two belong together; a pair is kept
    that is met ``least`` times and ``lift`` times as often as chance would have it.  The rarer of the two is the short
    form.  The table that reaches the driver holds the ``size`` most frequent pairs, as a vocabulary does.
    """
    first = F.substring_index("given", " ", 1)
    held = nodes.where("inst IS NOT NULL").select("key", "inst").distinct().join(keys.select("key", "sur", "given"), "key")
    places = held.where(F.length(first) > 1).select("sur", "inst", first.alias("t")).distinct()
    two = cut(places.groupBy("sur", "inst").agg(F.min("t").alias("x"), F.max("t").alias("y"), F.count(F.lit(1)).alias("k")).where("k = 2").select("x", "y"), "two")
    single = two.select(F.col("x").alias("t")).unionAll(two.select("y")).groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    met = two.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & (F.levenshtein("x", "y") > 1))
    met = met.join(single.select(F.col("t").alias("x"), F.col("c").alias("cx")), "x").join(single.select(F.col("t").alias("y"), F.col("c").alias("cy")), "y")
    total = two.agg(F.count(F.lit(1)).alias("n"))
    often = met.where(F.col("n") * 2 * total.scalar() >= lift * F.col("cx") * F.col("cy"))
    # how often a name is used at all says which of the two is the formal one
    used = places.groupBy("t").agg(F.count(F.lit(1)).alias("u"))
    sided = often.join(used.select(F.col("t").alias("x"), F.col("u").alias("ux")), "x").join(used.select(F.col("t").alias("y"), F.col("u").alias("uy")), "y")
    out: dict[str, tuple[str, ...]] = {}
    for r in sided.orderBy(F.desc("n"), "x", "y").limit(size).collect():
        short, formal = (r.x, r.y) if (r.ux, len(r.x), r.x) < (r.uy, len(r.y), r.y) else (r.y, r.x)
        out[short] = (*out.get(short, ()), formal)
    return out


def spelling_pairs(keys: DataFrame, forms: dict[str, tuple[str, ...]]) -> DataFrame:
    """``(key_v, key_c, n_v, n_c, kinds)``: ``key_v`` can be a variant of the more canonical ``key_c`` by these changes;
    ``keys`` has ``key, sur, given, n`` once a key.

    Surname tokens meet by hashes of their deletions; keys meet by a shared or near token together with a key of their
    given names, so namesakes of one surname with other given names are never paired.  A name without a given name
    meets all of its surname.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def bones(tokens: pd.Series) -> pd.Series:
        # the token as typed and what is left of it: either may be the one that is an edit away
        return tokens.map(lambda t: list({t, skeleton(t)}))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def meeting(given: pd.Series) -> pd.Series:
        return given.map(Channel(forms).meeting_keys)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def changed(sa: pd.Series, ga: pd.Series, sb: pd.Series, gb: pd.Series) -> pd.Series:
        c = Channel(forms)
        got = [c.changes(a, x, b, y) for a, x, b, y in zip(sa, ga, sb, gb)]
        return pd.Series([None if k is None else list(k) for k in got])

    full = F.length(F.split("given", " ")[0]) > 2
    keys = keys.withColumn("full", (full | F.col("given").rlike("^[a-z]{2} [a-z]{2,}")).cast("int"))
    by_token = keys.withColumn("token", F.explode(F.split("sur", " "))).where("length(token) > 1").withColumn("bone", F.explode(bones("token"))).select("key", "given", "bone").distinct()
    by_token = cut(by_token.withColumn("meet", F.explode(meeting("given"))).select("key", "bone", "meet"), "by_token")
    bone = by_token.select("bone").distinct().withColumn("h", F.explode(_deletions(F.col("bone"))))
    near = bone.select("h", F.col("bone").alias("bone_a")).join(bone.select("h", F.col("bone").alias("bone_b")), "h").where("bone_a < bone_b").select("bone_a", "bone_b").distinct()
    swapped = (F.levenshtein("bone_a", "bone_b") == 2) & (F.array_sort(F.split("bone_a", "")) == F.array_sort(F.split("bone_b", "")))
    near = near.where((F.levenshtein("bone_a", "bone_b") <= 1) | swapped)
    a = by_token.select("bone", "meet", F.col("key").alias("key_a"))
    b = by_token.select("bone", "meet", F.col("key").alias("key_b"))
    same = a.join(b, ["bone", "meet"]).where("key_a < key_b").select("key_a", "key_b")
    bare = a.where("meet = ''").select("bone", "key_a").join(b.where("meet <> ''").select("bone", "key_b").distinct(), "bone").select("key_a", "key_b")
    other = near.join(a.withColumnRenamed("bone", "bone_a"), "bone_a").join(b.withColumnRenamed("bone", "bone_b"), ["bone_b", "meet"]).select("key_a", "key_b")
    met = same.unionByName(bare).unionByName(other).where("key_a <> key_b").select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).distinct()
    cols = ["key", "sur", "given", "n", "full"]
    flat = met.join(keys.select(*[F.col(c).alias(f"{c}_a") for c in cols]), "key_a").join(keys.select(*[F.col(c).alias(f"{c}_b") for c in cols]), "key_b")
    scored = flat.withColumn("kinds", changed("sur_a", "given_a", "sur_b", "given_b")).where("kinds IS NOT NULL")
    # the fuller form is canonical; among equals the more frequent one
    a_first = F.struct("full_a", "n_a", "key_a") > F.struct("full_b", "n_b", "key_b")
    return scored.select(
        F.when(a_first, F.col("key_b")).otherwise(F.col("key_a")).alias("key_v"),
        F.when(a_first, F.col("key_a")).otherwise(F.col("key_b")).alias("key_c"),
        F.when(a_first, F.col("n_b")).otherwise(F.col("n_a")).alias("n_v"),
        F.when(a_first, F.col("n_a")).otherwise(F.col("n_b")).alias("n_c"),
        "kinds",
    )


def learned_costs(pairs: DataFrame, homes: DataFrame, mentions: int) -> dict[str, float]:
    """Log likelihood of each kind of change a mention: how many spellings came about by it, over all mentions.

    A pair of spellings that some institution holds both of counts once, however frequent the two are; pairs of one
    change tell which kind it was.  This is the counting step of EM from equal costs, with one added to each count.
    """
    v = homes.select(F.col("key").alias("key_v"), "inst")
    c = homes.select(F.col("key").alias("key_c"), "inst")
    one = pairs.where("size(kinds) = 1").select("key_v", "key_c", F.col("kinds")[0].alias("kind"))
    seen = one.join(v, "key_v").join(c, ["key_c", "inst"]).select("key_v", "key_c", "kind").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.kind: r.n for r in seen.collect()}  # one row a kind
    return {k: math.log((counts.get(k, 0) + 1) / (mentions + len(KINDS))) for k in KINDS}


# Words for institutions that are written short.
_SHORT_INST = {"inst": "institute", "univ": "university", "lab": "laboratory", "acad": "academy", "coll": "college", "obs": "observatory", "poly": "polytechnic", "cent": "centre", "ctr": "centre"}


def institution(col: str) -> Column:
    """The first part of an affiliation that is not a department, lower case, written out; null where there is none."""
    parts = F.filter(F.transform(F.split(F.lower(F.col(col)), ","), lambda p: F.trim(p)), lambda p: ~p.rlike("^(dept|dep|department)\\b") & (F.length(p) > 0))
    text = F.get(parts, F.lit(0))
    for short, long in _SHORT_INST.items():
        text = F.regexp_replace(text, f"\\b{short}\\b\\.?", long)
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def entities(signatures: DataFrame, floor: float = -16.0, surprise: float = 3.0, chance: float = 0.5, posterior: float = 0.5, backward: float = -1.0) -> DataFrame:
    """``(signature_id, author_name, entity)`` for each signature with a name; ``signatures`` has one row per id and
    ``author_affiliation, publication_id``.

    ``floor``: least log likelihood of a variant; ``surprise``: how many times as often as mistakes are to be expected a
    form may be met and still be taken for one; ``chance``: a shared co-author counts where fewer than this many
    meetings of the two names on one publication are to be expected by their frequencies (so a frequent name needs a
    rare co-author, and no name is left out); ``posterior``: what an entity must hold of a name's probability to take
    in a mention by the name alone; ``backward``: log odds of a canonical form being meant by its variant's mention.
    """
    sig = signatures.where(F.length(F.trim("author_name")) > 0)
    names = cut(parsed_names(sig.select("author_name")), "names")
    hot_names = hot_keys(sig.select("author_name"), "author_name")
    placed = salted(sig.select("signature_id", "author_name", "publication_id", institution("author_affiliation").alias("inst")), names.select("author_name", "key"), "author_name", hot_names)
    node = F.when(F.col("inst").isNotNull(), F.xxhash64("key", "inst")).otherwise(F.xxhash64(F.lit("sig"), "signature_id"))
    placed = cut(placed.withColumn("node", node), "placed")
    counts = cut(placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "counts")
    keys = cut(names.select("key", "sur", "given").dropDuplicates(["key"]).join(counts, "key"), "keys")
    nodes = cut(placed.groupBy("node", "key", "inst").agg(F.count(F.lit(1)).alias("n")), "nodes")
    homes = nodes.where("inst IS NOT NULL")
    forms = learned_forms(homes, keys)
    raw = cut(spelling_pairs(keys, forms), "spellings")
    costs = learned_costs(raw, homes.select("key", "inst"), placed.count())
    table = F.create_map(*[x for k in KINDS for x in (F.lit(k), F.lit(costs[k]))])
    ll = F.aggregate("kinds", F.lit(0.0), lambda t, k: t + table[k])
    # a mistyped form is as frequent as mistakes are; one that is met far more often is a name of its own
    mistake = F.arrays_overlap("kinds", F.array(F.lit("typo"), F.lit("shape")))
    likely = ~mistake | (F.col("n_v") <= surprise * (1 + F.col("n_c") * F.exp("ll")))
    pairs = cut(raw.withColumn("ll", ll).where(F.col("ll") >= floor).where(likely).select("key_v", "key_c", "n_c", "ll"), "pairs")

    # context 1: the institution
    v = homes.select(F.col("node").alias("node_v"), F.col("key").alias("key_v"), "inst")
    c = homes.select(F.col("node").alias("node_c"), F.col("key").alias("key_c"), "inst", F.col("n").alias("n_ctx"))
    by_inst = pairs.join(v, "key_v").join(c, ["key_c", "inst"]).select("node_v", "node_c", (F.col("ll") + F.log(1.0 + F.col("n_ctx")) + 2.0).alias("score"))

    # context 2: a shared co-author, where the two names would hardly meet by chance
    hot = hot_keys(placed.select("key"), "key")
    works = placed.agg(F.count_distinct("publication_id").alias("n"))
    sized = cut(salted(placed.select("publication_id", "node", "key"), counts, "key", hot), "sized")
    co = sized.select("publication_id", F.col("key").alias("co"), F.col("n").alias("n_co")).distinct()
    met = sized.join(co, "publication_id").where("key <> co").where(F.col("n") * F.col("n_co") < chance * works.scalar())
    seen = cut(met.groupBy("node", "key", "co").agg(F.count(F.lit(1)).alias("k")), "coauthors")
    # all of a name's mentions with one such co-author are one person; their lead stands for them
    lead = cut(seen.groupBy("key", "co").agg(F.max_by("node", F.struct("k", "node")).alias("lead"), F.sum("k").alias("k_all")), "leads")
    v = seen.select(F.col("node").alias("node_v"), F.col("key").alias("key_v"), "co")
    c = lead.select(F.col("key").alias("key_c"), "co", F.col("lead").alias("node_c"), "k_all")
    by_co = pairs.join(v, "key_v").join(c, ["key_c", "co"]).groupBy("node_v", "node_c").agg((F.max("ll") + F.log(1.0 + F.sum("k_all")) + 1.0).alias("score"))
    parents = by_inst.unionByName(by_co).groupBy("node_v").agg(F.max_by("node_c", F.struct("score", "node_c")).alias("node_c"))
    same = seen.join(lead, ["key", "co"]).where("node <> lead").select(F.col("node").alias("src"), F.col("lead").alias("dst"))
    trees = connected_components(parents.select(F.col("node_v").alias("src"), F.col("node_c").alias("dst")).unionByName(same))
    based = cut(nodes.join(trees.withColumnRenamed("vertex", "node"), "node", "left"), "based")

    # by the name alone: mentions without institution, and single mentions from elsewhere, that no context has placed;
    # the candidates are the entities of all spellings that can have been meant, by how often each is met in them
    mass = based.where("inst IS NOT NULL OR component IS NOT NULL").groupBy("key", F.coalesce("component", "node").alias("tree")).agg(F.sum("n").alias("m"))
    loose = cut(based.where("component IS NULL AND (inst IS NULL OR n = 1)").select("node", "key"), "loose")
    wanted = loose.select(F.col("key").alias("key_v")).distinct()
    back = pairs.select(F.col("key_c").alias("key_v"), F.col("key_v").alias("key_c"), (F.col("ll") + backward).alias("ll"))
    itself = wanted.select("key_v", F.col("key_v").alias("key_c"), F.lit(0.0).alias("ll"), F.lit(True).alias("own"))
    meant = pairs.select("key_v", "key_c", "ll").unionByName(back).join(wanted, "key_v").withColumn("own", F.lit(False)).unionByName(itself)
    odds = meant.join(mass.withColumnRenamed("key", "key_c"), "key_c").groupBy("key_v", "tree").agg(F.sum(F.exp("ll") * F.col("m")).alias("w"), F.sum("m").alias("m"), F.max("own").alias("own"))
    # an entity has two mentions or more; single ones count against it, but for one of the spelling itself: the mention
    # that is to be placed
    several = F.when(F.col("m") >= 2, F.col("w"))
    best = odds.groupBy("key_v").agg(
        F.max_by("tree", F.struct(several.alias("w"), "tree")).alias("tree"), F.max(several).alias("w"), (F.sum("w") - F.max(F.when(F.col("own") & (F.col("m") == 1), 1.0).otherwise(0.0))).alias("all_w")
    )
    taken = best.where(F.col("w") >= posterior * F.col("all_w")).select(F.col("key_v").alias("key"), F.col("tree").alias("home"))
    # a spelling that no entity holds twice is rare enough for its mentions to be one person; else they stay alone
    rooted = mass.where("m >= 2").select("key").distinct().withColumn("rooted", F.lit(True))
    herds = loose.groupBy("key").agg(F.min("node").alias("herd")).join(rooted, "key", "left").select("key", F.when(F.col("rooted").isNull(), F.col("herd")).alias("herd"))
    led = salted(loose, herds.join(taken, "key", "left").select("key", F.coalesce("home", "herd").alias("led")), "key", hot).select("node", "led")
    final = based.select("node", "component").join(led, "node", "left").select("node", F.coalesce("component", "led", "node").alias("entity"))
    return placed.join(final, "node").select("signature_id", "author_name", "entity")


def variant_pairs(members: DataFrame) -> DataFrame:
    """``(signature_id_a, signature_id_b)``, a < b, of members of one entity under different stored names; only
    entities with several names are expanded, and copies of one name are never paired."""
    members = members.select("entity", "author_name", "signature_id")
    names = members.groupBy("entity", "author_name").agg(F.count(F.lit(1)).alias("n"))
    several = names.groupBy("entity").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("entity")
    kept = cut(members.join(several, "entity"), "variant_members")
    held = kept.select("entity", "author_name").distinct()
    named = held.select("entity", F.col("author_name").alias("name_a")).join(held.select("entity", F.col("author_name").alias("name_b")), "entity").where("name_a < name_b")
    a = kept.select("entity", F.col("author_name").alias("name_a"), F.col("signature_id").alias("a"))
    b = kept.select("entity", F.col("author_name").alias("name_b"), F.col("signature_id").alias("b"))
    both = named.join(a, ["entity", "name_a"]).join(b, ["entity", "name_b"])
    return both.select(F.least("a", "b").alias("signature_id_a"), F.greatest("a", "b").alias("signature_id_b"))
