"""Variant spellings of one person's or organisation's name.

A name is written in short forms: each of its parts with the initial of every other (``hadostrom tt``, ``terrence hh``; the
initial twice, so that another initial is two edits away), nicknames also as the names they shorten, a person with one
part with any initial, an organisation by its own parts alone. So order, middle names and abbreviated given names
leave forms in common, and spelling errors leave them near.

Forms are partitioned in metric space, those of each initial apart (another initial is beyond the radius). Pivots are the
most frequent forms of an initial. The distance to a pivot is the bag distance (the
larger number of letters that one form has more than the other): a metric, never above the unrestricted
Damerau-Levenshtein distance, and one matrix product for many forms. A form is at home with its nearest pivot p, the
first of equals. It is copied to every later cell q where d(y, q) <= d(y, p) + 2 r - 1: if x is at home in q, y in an earlier
p and they are at most r apart, then d(y, q) <= d(x, q) + r <= d(x, p) - 1 + r (q was strictly nearer) <= d(y, p) + 2 r - 1. The number
of pivots grows with the number of forms; cells that are still large are divided again by pivots of their own. Inside a
cell an exact join finds all pairs within the radius: bag distances propose, the true edit distance decides.

Rows are candidates when their names have a form in common or two within the radius, *and* they share a piece of
evidence: an identifier, birth date, telephone number or address (a contact only counts where a birth date is missing).
Candidates are judged on whole names and all evidence, and linked rows are joined to entities by star rounds.

A spelling is compared once however many rows bear it, and rows meet only under one key of form and evidence; a name
borne by a third of all rows is split by its evidence. Null and blank names have no forms and are never linked; equal
names with different identifiers stay apart; rows without evidence stay alone; repeated rows with equal name texts
belong to one entity but are no pair of variants; names of any length are compared whole; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.session import checkpointed

RADIUS = 1
#: Shortest parts whose typing errors are forgiven when whole names are judged.
LEAST_LENGTH = 4
#: Forms that a pivot stands for, pivots of a part at most, and of a cell that is divided again.
PER_PIVOT, PIVOTS, MORE_PIVOTS = 250, 2048, 64
#: Forms from which on a cell is divided again, and how often parts and cells are divided at most.
CELL, LEVELS = 50_000, 4
#: Letters of forms fall into so many kinds, each counted up to a limit: both only make bag distances smaller.
LETTERS, COUNTED = 32, 3
#: Bag distances that are held at a time.
BLOCK = 4_000_000

#: Titles, degrees, legal forms and particles that are no part of a name proper.
TITLES = frozenset("dr mr mrs ms miss prof sir md do rn np pa phd dds dpm lpn jr sr ii iii esq the of and pllc llc inc pc llp corp co ltd".split())
PARTICLES = frozenset("van von der den de la del di da le dela ten ter vander vanden vonder".split())
#: Words of organisations and their short forms.
ORG_WORDS = {
    short: word
    for word, shorts in {
        "associates": "assoc assocs asc",
        "center": "ctr centre cntr",
        "childrens": "child childs",
        "clinic": "clin cln",
        "community": "comm cmty cmnty",
        "county": "cnty co",
        "dental": "dntl",
        "family": "fam fmly",
        "group": "grp gp",
        "health": "hlth",
        "heart": "hrt",
        "hospital": "hosp hsp",
        "imaging": "img",
        "institute": "inst",
        "medical": "med",
        "memorial": "mem meml",
        "mount": "mt",
        "north": "n no",
        "south": "s so",
        "east": "e",
        "west": "w",
        "saint": "st",
        "orthopedic": "ortho orth",
        "partners": "ptnrs prtnrs ptrs",
        "pediatric": "peds ped",
        "physicians": "phys",
        "practice": "prac",
        "radiology": "rad radiol",
        "regional": "reg rgnl regl",
        "rehabilitation": "rehab",
        "services": "svc svcs srvcs",
        "surgery": "surg",
        "university": "univ",
        "valley": "vly",
        "wellness": "welln",
    }.items()
    for short in [word, *shorts.split()]
}
_ORG_SIGNS = frozenset(w for w in ORG_WORDS.values() if w not in ("mount", "north", "south", "east", "west", "saint", "valley"))
#: Short forms of given names.
NICKNAMES = {
    "alexander": "alex al sandy", "alexandra": "alex sandra lexi", "alejandro": "alex ale", "amanda": "mandy", "andrew": "andy drew", "anthony": "tony",
    "antonia": "toni", "augustin": "gus", "barbara": "barb", "bartholomew": "bart", "beatrix": "bea trixie", "benjamin": "ben benny",
    "cassandra": "cass cassie sandra", "catherine": "cathy kate", "charles": "charlie chuck", "christopher": "chris kit topher", "constance": "connie",
    "cornelius": "corny neil", "daniel": "dan danny", "david": "dave", "deborah": "deb debbie", "dorothy": "dot dottie", "edward": "ed ned ted eddie",
    "elizabeth": "liz beth betty eliza lizzie", "francesca": "fran frankie", "francis": "frank", "frederick": "fred fritz freddie", "gabriela": "gabi gaby",
    "gregory": "greg", "henrietta": "hetty etta", "henry": "hank harry", "isadora": "izzy dora isa", "jacqueline": "jackie", "james": "jim jimmy",
    "jennifer": "jen jenny", "john": "jack johnny", "jonathan": "jon jonny", "jose": "pepe", "joseph": "joe joey", "josephine": "jo josie", "katharina": "kat kathy kate",
    "lawrence": "larry", "leopold": "leo", "ludmila": "mila", "margaret": "maggie meg peggy", "maribel": "mari belle", "matthias": "matt matty", "matthew": "matt",
    "maximilian": "max", "michael": "mike mick", "nathaniel": "nate nat", "nicholas": "nick", "osvaldo": "ozzie waldo", "patricia": "pat trish patty", "patrick": "pat paddy",
    "philip": "phil", "philippa": "pippa", "raymond": "ray", "rebecca": "becca becky", "reginald": "reggie", "richard": "rich rick dick", "robert": "rob bob bobby",
    "ronald": "ron", "samuel": "sam", "stephen": "steve", "susannah": "sue susie", "terrence": "terry", "theodora": "dora thea", "theodore": "ted theo", "thomas": "tom tommy",
    "timothy": "tim", "veronica": "ronnie vera", "victoria": "vicky tori", "wilhelmina": "mina willa", "william": "will bill billy",
}
_FULL = defaultdict(set)
for _name, _shorts in NICKNAMES.items():
    for _short in _shorts.split():
        _FULL[_short].add(_name)

_SPLIT_PARTICLE = re.compile(r"\b(Vander|Vanden|Vonder|Dela|De|Van|Von|Der|La)(?=[A-Z][a-z])")
_FOLDS = str.maketrans({"ø": "o", "Ø": "O", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "ł": "l", "Ł": "L", "đ": "d", "’": "'"})


def fold(text: str) -> str:
    decomposed = unicodedata.normalize("NFKD", text.translate(_FOLDS))
    return "".join(c for c in decomposed if not unicodedata.combining(c))


def parts(name: str | None) -> tuple[list[str], list[str], list[str]]:
    """(distinctive tokens, initials, organisation words) of a name, in their order."""
    if not name:
        return [], [], []
    plain = _SPLIT_PARTICLE.sub(r"\1 ", fold(name)).lower().replace("'", "")
    plain = re.sub(r"\bm\.\s?d\b\.?|\bd\.\s?o\b\.?", " ", plain)
    raw = [t for t in re.split(r"[^a-z0-9]+", plain) if t]
    words = [t for t in raw if t not in TITLES and t not in PARTICLES]
    is_org = any(ORG_WORDS.get(t) in _ORG_SIGNS for t in raw if len(t) > 2)
    if is_org:
        org = [ORG_WORDS[t] for t in raw if t in ORG_WORDS]
        tokens = [t for t in words if t not in ORG_WORDS]
    else:
        org, tokens = [], words
    initials = [t for t in tokens if len(t) == 1]
    return [t for t in tokens if len(t) > 1], initials, org


def forms(name: str | None) -> list[str]:
    """Short forms under which a name is found."""
    tokens, initials, org = parts(name)
    whole = lambda t: {t, *_FULL.get(t, ())}
    if org:
        return sorted({f"{t} **" for t in tokens})
    out: set[str] = set()
    for k, token in enumerate(tokens):
        rest = [*tokens[:k], *tokens[k + 1 :]]
        firsts = {f[0] for t in rest for f in (*whole(t), *NICKNAMES.get(t, "").split())} | set(initials) or set("abcdefghijklmnopqrstuvwxyz")
        out |= {f"{t} {c}{c}" for t in whole(token) for c in firsts}
        if any(len(t) <= 4 for t in rest):  # it may be an acronym of an organisation's last words
            out.add(f"{token} **")
    return sorted(out)


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: insert, delete, replace, swap of neighbours; a metric."""
    last: dict[str, int] = {}
    worst = len(a) + len(b)
    rows = [[worst] * (len(b) + 2), [worst, *range(len(b) + 1)]]
    for i, ca in enumerate(a, 1):
        row, last_b = [worst, i], 0
        for j, cb in enumerate(b, 1):
            k, col = last.get(cb, 0), last_b
            cost = ca != cb
            if not cost:
                last_b = j
            row.append(min(rows[i][j] + cost, row[j] + 1, rows[i][j + 1] + 1, rows[k][col] + i - k - 1 + 1 + j - col - 1))
        rows.append(row)
        last[ca] = i
    return rows[-1][-1]


def within_one(a: str, b: str) -> bool:
    """Whether the distance is at most 1."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    if len(a) > len(b):
        return a[i + 1 :] == b[i:]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of each text in unary (one column per kind of letter and count), and how many they are."""
    out = np.zeros((len(texts), LETTERS * COUNTED), "float32")
    sizes = [len(t) for t in texts]
    row = np.repeat(np.arange(len(texts)), sizes)
    kind = np.frombuffer("".join(texts).encode("utf-32-le"), "uint32").astype("int64") % LETTERS
    keys, counts = np.unique(row * LETTERS + kind, return_counts=True)
    for n in range(COUNTED):
        own = keys[counts > n]
        out[own // LETTERS, own % LETTERS * COUNTED + n] = 1
    return out, out.sum(axis=1)


def bag_distances(texts: tuple[np.ndarray, np.ndarray], pivots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """texts x pivots: the larger number of letters that one has more than the other."""
    return np.maximum(texts[1][:, None], pivots[1]) - texts[0] @ pivots[0].T


def cells_of(texts: list[str], pivots: tuple[np.ndarray, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, cell, at home) of every cell that a text belongs or is copied to."""
    d = bag_distances(bags(texts), pivots)
    home = d.argmin(axis=1)
    least = d[np.arange(len(texts)), home]
    # later cells only, and by one less than to both sides: see the module's text
    kept = (d <= least[:, None] + 2 * radius - 1) & (np.arange(d.shape[1]) >= home[:, None])
    text, cell = np.nonzero(kept)
    return text, cell, home[text] == cell


def pairs_in_cell(texts: list[str], homes: np.ndarray, full: int, radius: int = RADIUS) -> Iterator[tuple[str, str]]:
    """All pairs within the radius that are at home, one or the other, at every level; each once, smaller first."""
    codes, sizes = bags(texts)
    near = within_one if radius == 1 else lambda a, b: distance(a, b) <= radius
    step = max(1, BLOCK // len(texts))
    for at in range(0, len(texts), step):
        one = slice(at, at + step)
        d = bag_distances((codes[one], sizes[one]), (codes[at:], sizes[at:]))
        x, y = np.nonzero(d <= radius)
        kept = (x < y) & (homes[at + x] | homes[at + y] == full)
        for i, j in zip((at + x[kept]).tolist(), (at + y[kept]).tolist()):
            if near(texts[i], texts[j]):
                yield min(texts[i], texts[j]), max(texts[i], texts[j])


_CELLS = "cell long, form string, homes int, full int"


def neighbours(found: DataFrame, radius: int = RADIUS, per_pivot: int = PER_PIVOT, most: int = CELL) -> DataFrame:
    """found: form (distinct), n (rows), part (forms of different parts are never near) -> a, b: all pairs of forms within the
    radius, a <= b: a form is as near to itself as any other can be."""
    spark = found.sparkSession
    # a given number of tasks: the distances cost CPU, not bytes, and would else be merged into one task
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = found.select(F.xxhash64("part").alias("cell"), "form", F.lit(0).alias("homes"), F.lit(0).alias("full"), "n")
    done, level, limit, many = None, 0, 2 * per_pivot, PIVOTS
    while level < LEVELS:
        # large cells are few (at most the forms by ``limit``), and so are their pivots
        large = {r[0]: min(many, -(-r[1] // per_pivot)) for r in cells.groupBy("cell").count().where(F.col("count") > limit).collect()}
        if not large:
            break
        order = F.row_number().over(W.partitionBy("cell").orderBy(F.desc("n"), F.xxhash64("form"), "form"))
        pivots: dict[int, list[str]] = defaultdict(list)
        for r in cells.where(F.col("cell").isin(list(large))).withColumn("nth", order).where(F.col("nth") <= many).select("cell", "form", "nth").collect():
            if r[2] <= large[r[0]]:
                pivots[r[0]].append(r[1])
        rest = cells.where(~F.col("cell").isin(list(large)))
        done = rest if done is None else done.unionByName(rest)
        hard = cells.where(F.col("cell").isin(list(large))).repartition(tasks, "form")
        cells = checkpointed(_divided(hard, dict(pivots), level, radius).withColumn("n", F.lit(1).cast("long")))
        level, limit, many = level + 1, most, MORE_PIVOTS
    whole = cells if done is None else done.unionByName(cells)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("form")
        texts, homes, full = pdf["form"].tolist(), pdf["homes"].to_numpy(), int(pdf["full"].iloc[0])
        own = [(t, t) for t, h in zip(texts, homes) if h == full]
        return pd.DataFrame(own + list(pairs_in_cell(texts, homes, full, radius)), columns=["a", "b"])

    return whole.select("cell", "form", "homes", "full").groupBy("cell").applyInPandas(join, "a string, b string").distinct()


def _divided(members: DataFrame, pivots: dict[int, list[str]], level: int, radius: int) -> DataFrame:
    """Members of cells in the cells around each cell's own pivots; ``homes`` and ``full`` have a bit per level."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = {c: bags(p) for c, p in pivots.items()}
        for whole in batches:
            for cell, pdf in whole.groupby("cell"):
                for at in range(0, len(pdf), 4096):
                    some = pdf.iloc[at : at + 4096]
                    text, near, home = cells_of(some["form"].tolist(), own[cell], radius)
                    ids = np.array([xxhash.xxh64_intdigest(f"{cell} {p}") >> 1 for p in range(len(own[cell][1]))], "int64")
                    homes = some["homes"].to_numpy()[text] | (home.astype("int32") << level)
                    yield pd.DataFrame({"cell": ids[near], "form": some["form"].to_numpy(object)[text], "homes": homes.astype("int32"), "full": (some["full"].to_numpy()[text] | 1 << level).astype("int32")})

    return members.select("cell", "form", "homes", "full").mapInPandas(run, _CELLS)


def given_match(a: str, b: str) -> int:
    """2: one name (equal, nickname, spelling); 1: an initial fits; 0: different."""
    if len(a) == 1 or len(b) == 1:
        return int(a[0] == b[0])
    if a == b or a in _FULL.get(b, ()) or b in _FULL.get(a, ()) or _FULL.get(a, set()) & _FULL.get(b, set()):
        return 2
    if min(len(a), len(b)) >= LEAST_LENGTH - 1 and distance(a, b) <= (1 if min(len(a), len(b)) < 8 else 2):
        return 2
    for x, y in ((a, b), (b, a)):
        for full in _FULL.get(x, ()):
            if distance(full, y) <= 1:
                return 2
    return 0


def same_name(a: str, b: str) -> int:
    """How well two whole names agree: 3 all parts, 2 all but given names that are initials only, 1 one part, 0 none."""
    ta, ia, oa = parts(a)
    tb, ib, ob = parts(b)
    if not ta or not tb:
        return 0
    if bool(oa) != bool(ob):
        # an organisation may be written with an acronym for its last words
        if not (oa or ob):
            return 0
        words, short = (oa, tb + ib) if oa else (ob, ta + ia)
        shared = any(given_match(x, y) == 2 for x in ta for y in tb)
        acronym = "".join(w[0] for w in words)
        return 3 if shared and any(len(s) > 1 and acronym.endswith(s) for s in short) else int(shared)
    if oa and ob:
        shared = any(x == y or (min(len(x), len(y)) >= LEAST_LENGTH and distance(x, y) <= 2) for x in ta for y in tb)
        if not shared:
            return 0
        common = len(set(oa) & set(ob)) / max(1, min(len(set(oa)), len(set(ob))))
        rest = [t for t in ta + tb if 2 <= len(t) <= 4]
        acronym = any("".join(w[0] for w in o).endswith(t) for o in (oa, ob) for t in rest)
        return 3 if common >= 0.5 or acronym else 1
    left = list(tb)
    hits = 0
    for x in ta:
        best = max(range(len(left)), key=lambda k: given_match(x, left[k]), default=None)
        if best is not None and given_match(x, left[best]) == 2:
            left.pop(best)
            hits += 1
    shorter = min(len(ta), len(tb))
    if hits >= 2:
        return 3
    if hits == 1 and shorter == 1:
        # one side has a surname only: its initials must fit the other side's given name
        initials, others = (ia, [t for t in tb if given_match(ta[0], t) < 2]) if len(ta) == 1 else (ib, [t for t in ta if given_match(tb[0], t) < 2])
        if len(ta) == len(tb) == 1:
            return 2 if not ia or not ib or ia[0] == ib[0] else 0
        return 2 if not initials or not others or any(o[0] == i for o in others for i in initials[:1]) else 0
    return int(hits > 0)


#: Street words and their short forms.
STREETS = {"street": "st", "avenue": "ave", "road": "rd", "lane": "ln", "drive": "dr", "court": "ct", "boulevard": "blvd", "place": "pl", "square": "sq", "apartment": "apt", "suite": "ste"}


def address_key(address: Column) -> Column:
    """An address with number and postal code in one spelling; null where either is missing."""
    plain = F.btrim(F.regexp_replace(F.lower(address), r"[^a-z0-9]+", " "))
    short = F.array_join(F.transform(F.split(plain, " "), lambda w: F.coalesce(F.create_map(*[F.lit(x) for kv in STREETS.items() for x in kv])[w], w)), " ")
    return F.when(plain.rlike(r"^\d+ .* [a-z]{2} \d{5}(?: \d{4})?$"), short)


def evidence_keys(columns: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), F.col(c))) for c in columns]))


def link(rows: DataFrame, strong: list[str], weak: list[str]) -> DataFrame:
    """rows: id, name and text columns of evidence -> id_a, id_b of rows that are one entity by name and evidence."""

    @F.pandas_udf("array<string>")
    def written(names: pd.Series) -> pd.Series:
        return names.map(forms)

    columns = strong + weak
    named = rows.where(F.length(F.btrim("name")) > 0).select("id", "name", *columns)
    distinct = named.groupBy("name").agg(F.count("*").alias("n")).withColumn("forms", written("name"))
    spellings = checkpointed(distinct.where(F.size("forms") > 0).select("name", F.explode("forms").alias("form"), "n"))
    counts = checkpointed(spellings.groupBy("form").agg(F.sum("n").alias("n")))
    near = neighbours(counts.withColumn("part", F.substring("form", -1, 1)))
    # the rarer form of a pair leads to the more frequent one, so that few rows follow many links
    sized = near.join(counts.select(F.col("form").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("form").alias("b"), F.col("n").alias("nb")), "b")
    upward = F.col("na") <= F.col("nb")
    leads = sized.select(F.when(upward, F.col("a")).otherwise(F.col("b")).alias("form"), F.when(upward, F.col("b")).otherwise(F.col("a")).alias("under"))
    under = spellings.join(leads, "form").select("name", "under").distinct()
    # contacts only count where one side has no birth date: two rows with one needn't meet under a contact
    dated = F.col("dob").isNotNull() if "dob" in weak else F.lit(False)
    contact = F.exists(F.array(*[F.lit(f"{c}:") for c in weak if c != "dob"]).cast("array<string>"), lambda c: F.startswith(F.col("e"), c))
    keyed = named.withColumn("e", F.explode(evidence_keys(columns))).withColumn("open", ~(dated & contact)).select("id", "name", "e", "open")
    keyed = checkpointed(keyed.join(under, "name").select("id", F.xxhash64("under", "e").alias("key"), "open"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max("open").alias("o")).where("n > 1 and o").select("key")
    useful = keyed.join(shared, "key", "left_semi")
    left, right = (useful.select(F.col("id").alias(f"id_{x}"), "key", F.col("open").alias(f"o_{x}")) for x in "ab")
    met = left.join(right, "key").where("id_a < id_b and (o_a or o_b)").select("id_a", "id_b").distinct()
    side = lambda s: named.select(F.col("id").alias(f"id_{s}"), F.col("name").alias(f"name_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in columns])
    beside = met.join(side("a"), "id_a").join(side("b"), "id_b")
    equal = lambda c: F.coalesce(F.col(f"{c}_a") == F.col(f"{c}_b"), F.lit(False))
    clash = lambda c: F.coalesce(F.col(f"{c}_a") != F.col(f"{c}_b"), F.lit(False))
    either = lambda f, names: F.coalesce(*[F.when(f(c), True) for c in names], F.lit(False)) if names else F.lit(False)

    @F.pandas_udf("int")
    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([same_name(x, y) for x, y in zip(a, b)], dtype="int32")

    scored = beside.where(~either(clash, strong)).select(
        "id_a",
        "id_b",
        either(equal, strong).alias("strong"),
        *[F.when(equal(c), 1).when(clash(c), -1).otherwise(0).alias(f"is_{c}") for c in weak],
        agree("name_a", "name_b").alias("names"),
    )
    dob = F.col("is_dob") if "dob" in weak else F.lit(0)
    contact = F.greatest(*[F.when(F.col(f"is_{c}") == 1, 1).otherwise(0) for c in weak if c != "dob"], F.lit(0)) == 1
    one = (
        (F.col("strong") & ((F.col("names") >= 1) | (dob == 1)) & (dob >= 0))
        | ((F.col("names") == 3) & (dob == 1))
        | ((F.col("names") == 3) & contact & (dob == 0))
        | ((F.col("names") == 2) & contact & (dob == 1))
    )
    return scored.where(one).select("id_a", "id_b")


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and small-star round; an edge leads from a node u to a smaller one v."""
    # large-star: the larger neighbours of a node go to the smallest of its neighbourhood
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    # small-star: the smaller neighbours of a node, and the node itself, go to the smallest of them
    smallest = large.groupBy("u").agg(F.min("v").alias("m"))
    return large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(smallest.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def entities(links: DataFrame) -> DataFrame:
    """id, entity (smallest id reached): star rounds, a written table each, until nothing changes."""
    edges = checkpointed(links.select(F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v")).where("u != v").distinct())
    sign = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())
    known = sign(edges)
    while True:
        edges = checkpointed(_star(edges))
        now = sign(edges)
        if now == known:
            break
        known = now
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("entity", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("entity")).unionByName(roots)


def _alike(rows: DataFrame, strong: list[str], weak: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with the kind of their name and evidence, and one row per kind with the entity it is linked to."""
    columns = ["name", *strong, *weak]
    kind = F.xxhash64(*[F.struct(F.col(c).isNull().alias("n"), F.coalesce(c, F.lit("")).alias("v")) for c in columns])
    marked = rows.select("id", *columns).withColumn("kind", kind)
    alike = marked.groupBy("kind").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in columns])
    linked = entities(link(alike, strong, weak))
    return marked.select("id", "kind"), checkpointed(linked.join(alike.select("id", "kind", "name"), "id").select("entity", "kind", "name"))


def memberships(rows: DataFrame, strong: list[str], weak: list[str]) -> DataFrame:
    """id, entity: every row that is linked to another spelling or other evidence of its entity. Grows with the rows."""
    marked, named = _alike(rows, strong, weak)
    return marked.join(named, "kind").select("id", "entity")


def variants(rows: DataFrame, strong: list[str], weak: list[str]) -> DataFrame:
    """id_a, id_b: rows of one entity whose name texts differ, id_a < id_b.

    Rows equal in name and evidence are linked as one; pairs are formed between the different names of an entity and
    only then between their rows, so that many copies of one row meet nothing but what the result holds.
    """
    marked, named = _alike(rows, strong, weak)
    members = named.join(marked, "kind").select("entity", "name", "id")
    spelled = named.select("entity", "name").distinct()
    a, b = (spelled.select("entity", F.col("name").alias(f"name_{s}")) for s in "ab")
    pairs = a.join(b, "entity").where("name_a < name_b")
    first = pairs.join(members.select("entity", F.col("name").alias("name_a"), F.col("id").alias("x")), ["entity", "name_a"])
    both = first.join(members.select("entity", F.col("name").alias("name_b"), F.col("id").alias("y")), ["entity", "name_b"])
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
