"""Matching entities across sources without keys: a cascade of exact joins on weaker and weaker attributes.

The records of both sources are taken apart alike and put into one set. Records whose surname, given name, suffix and
state agree are one group. Each rule joins groups, or records, on a weaker key with all groups under that key, checks the
surnames by edit distance and the attributes the key leaves out for conflicts, and what it resolves leaves the
cascade by an anti-join. A group is linked to the closest it has no conflict with, among those with a number or, failing
that, of more rows; links are followed to their end. So two people of one name in two states, with numbers that differ by
more than a mistyping, stay two.

A rule's confidence is its labelled precision: all pairs it finds, open or not, are labelled by an attribute that it
doesn't use, where both sides have one (the allotment number for rules on names, the middle initial for rules on the
number), as (agreeing + 1) / (labelled + 2). Labels are counted before conflicts are put aside. A pair has the
smaller confidence of its two records.

Defined cases: records that name nobody match nothing; null attributes neither agree nor conflict; repeated
rows are rows of the same person; empty sources give no pairs; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlark.functions.segments import kept_keys, sought_keys
from ledgerlark.llm.names import NameWords, first_named, learn_short_forms, number, parse_names
from ledgerlark.runtime import Kept, finished, fits, small

SCHEMA = "src string, id long, name string, tribe string, state string, allotment long"


def records(src: str, df: DataFrame, id_: str, name: str, tribe: str, state: str, allotment: str) -> DataFrame:
    """A source in the common shape (SCHEMA), with the first name of each entry and the number of the allotment."""
    c = lambda x: F.col(f"`{x}`")
    out = df.where(F.trim(c(name)) != "").select(
        F.lit(src).alias("src"), c(id_).cast("long").alias("id"), first_named(c(name)).alias("name"), F.nullif(F.upper(F.trim(c(tribe))), F.lit("")).alias("tribe"),
        F.nullif(F.upper(F.trim(c(state))), F.lit("")).alias("state"), number(c(allotment)).try_cast("bigint").alias("allotment"),
    )
    return out.where("name != ''")


def parsed(all_records: DataFrame, words: NameWords = NameWords()) -> DataFrame:
    """Records with their name's parts; a null state is taken from the state most common with the record's tribe label."""
    rows = Kept(all_records).df  # read three times below; the names are taken apart once
    # Labels are cleaned once per spelling, not once per record.
    spelt = Kept(rows.where("tribe IS NOT NULL AND state IS NOT NULL").groupBy("tribe", "state").agg(F.count("*").alias("n"))).df
    clean = F.regexp_replace(F.regexp_replace("tribe", words.generic, "") if words.generic else F.col("tribe"), "[^A-Z]", "").alias("clean")
    of_tribe = spelt.groupBy(clean, "state").agg(F.sum("n").alias("n")).groupBy("clean").agg(F.max_by("state", F.struct("n", "state")).alias("tribe_state"))
    lacking = rows.where("state IS NULL AND tribe IS NOT NULL").select("tribe").distinct().select("tribe", clean)
    found = Kept(lacking.join(of_tribe, "clean").select("tribe", "tribe_state")).df
    given, short = learn_short_forms(rows, words=words)
    filled = rows.join(small(found), "tribe", "left").withColumn("state", F.coalesce("state", "tribe_state")).drop("tribe_state", "tribe")
    return parse_names(filled, "name", given, short, words)


def _code(column: str) -> Column:
    """A text as a number; null stays null."""
    return F.when(F.col(column).isNotNull(), F.xxhash64(column))


_NAME = ["surname", "given", "suffix", "state"]


def near_numbers(a: Column, b: Column) -> Column:
    """Whether two numbers are equal or one mistyping apart: a digit more, less or other, or two neighbours swapped."""
    x, y = a.cast("string"), b.cast("string")
    swapped = lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.lit(1)), F.substring(x, i, F.lit(1)), F.substring(x, i + 2, F.length(x))) == y
    swap = (F.length(x) == F.length(y)) & (F.length(x) > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), swapped)
    return (F.levenshtein(x, y, 1) >= 0) | swap


def same_number(a: str, b: str) -> Column:
    """Whether two groups share a number; null where one has none."""
    return F.arrays_overlap(f"{a}nums", f"{b}nums")


def number_conflict(a: str, b: str) -> Column:
    """Whether two groups have numbers of which none are equal or one mistyping apart."""
    near = F.exists(f"{a}nums", lambda x: F.exists(f"{b}nums", lambda y: near_numbers(x, y)))
    return F.coalesce(~same_number(a, b) & ~near, F.lit(False))


#: Groups from which on their pairs are sought in SLICES of the keys, one after the other, so that no more than a slice is shuffled at a time.
SLICED = 1_000_000
SLICES = 4


def near_surnames(groups: DataFrame, slices: int = 1) -> DataFrame:
    """Pairs (a, b, distance), a < b, of groups of one given name, suffix and state with surnames within two edits; no such pair is left out.

    Of a surname's three segments two edits leave one whole, shifted by no more than the edits on either side
    of it. Every surname is found by its segments and looks for those of surnames as long as it or up to two shorter.
    """
    rows = groups.select("g", "surname", F.xxhash64("given", "suffix", "state").alias("p"))
    if slices == 1:
        return _near(rows)
    return reduce(DataFrame.unionByName, [Kept(_near(rows.where(F.pmod(F.xxhash64("p"), F.lit(slices)) == i))).df for i in range(slices)])


def _near(rows: DataFrame) -> DataFrame:
    side = lambda keys, a: keys.select(F.col("g").alias(a), F.col("surname").alias(f"s{a}"), F.col("k").alias(f"k{a}"))
    kept, sought = kept_keys(rows, "surname", ["p"], 2), sought_keys(rows, "surname", ["p"], 2, own=False)
    # A segment unmoved in a surname as long is one that both are found by: those meet among themselves, and aren't laid out and shuffled once more.
    # The surnames go along, so that no more leaves the joins than what is near.
    near = lambda pairs: pairs.select("x", "y", F.levenshtein("sx", "sy", 2).alias("distance")).where("distance >= 0")
    y = side(kept, "y").hint("shuffle_hash")  # nothing is sorted; a surname has three keys, so that a partition of them stays small
    pairs = near(side(kept, "x").join(y, F.expr("kx = ky AND x < y"))).unionByName(near(side(sought, "x").join(y, F.expr("kx = ky AND x != y"))))
    return pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("distance").alias("distance"))


_CARRIED = ("n", "surname", "nums", "middle")


#: Passes of exact joins, each with its rules: (rule, key, edits of the surname allowed, what labels it); ``x`` in a key is each number of a group.
_PASSES = [
    [("name", ("surname", "given", "suffix"), 0, "number"), ("number", ("x", "given", "suffix", "state"), 3, "middle")],
    [("number_front", ("x", "given", "suffix", "front"), 2, "middle"), ("number_back", ("x", "given", "suffix", "back"), 2, "middle")],
]
#: The pass after them: any two edits within given name, suffix and state.
_SURNAME = ("surname", ("given", "suffix", "state"), 2, "number")


def _joined(groups: DataFrame, rules: list[tuple[str, tuple[str, ...], int, str]]) -> DataFrame:
    """Groups with every stronger group under one key of the rules whose surname is near enough; links lead to the one with a number, then the larger, so they never form a ring."""
    parts = {"front": F.substring("surname", 1, 3), "back": F.substring("surname", -3, 3)}
    # A row per number, and for each its keys; keys without a number are made once, with the first. No lambdas over arrays: those aren't compiled.
    made = []
    for at, (rule, key, _, _) in enumerate(rules):
        code = F.xxhash64(F.lit(rule), *[parts.get(k, F.col(k)) for k in key])
        made.append(F.struct(F.lit(at).alias("at"), F.when(F.col("x").isNotNull() if "x" in key else F.coalesce(F.col("place"), F.lit(0)) == 0, code).alias("key")))
    numbered = groups.select("g", *_NAME, *[c for c in _CARRIED if c not in _NAME], F.posexplode_outer("nums").alias("place", "x"))
    keyed = numbered.select(F.explode(F.array(*made)).alias("k"), "g", *_CARRIED).where("k.key IS NOT NULL").select("k.key", "k.at", "g", *_CARRIED)
    # Most keys are one group's: only the others' groups are joined, if those keys are few enough to be sent to all.
    shared = Kept(keyed.groupBy("key").agg(F.min("g").alias("lo_g"), F.max("g").alias("hi_g")).where("lo_g != hi_g").select("key")).df
    if fits(shared):
        keyed = Kept(keyed.join(F.broadcast(shared), "key", "left_semi")).df
    leaders = keyed.select(*[F.col(c).alias(f"l_{c}") for c in keyed.columns])
    strength = lambda x: F.struct(F.col(f"{x}nums").isNotNull(), F.col(f"{x}n"), F.col(f"{x}g"))
    pairs = keyed.join(leaders, (F.col("key") == F.col("l_key")) & (F.col("at") == F.col("l_at"))).where(strength("l_") > strength(""))
    of_rule = lambda i: F.array(*[F.lit(r[i]) for r in rules])[F.col("at")]
    found = pairs.withColumn("distance", F.levenshtein("surname", "l_surname")).where(F.col("distance") <= of_rule(2))
    return found.withColumn("rule", of_rule(0)).drop("key", "at", "l_key", "l_at")


def _by_surname(groups: DataFrame, slices: int) -> DataFrame:
    """Groups with every stronger group of one given name, suffix and state whose surname is within two edits, as ``_joined`` gives them."""
    near = near_surnames(groups, slices)
    pairs = near.join(groups.select(F.col("g").alias("a"), *[F.col(c).alias(f"a_{c}") for c in _CARRIED]), "a").join(groups.select(F.col("g").alias("b"), *[F.col(c).alias(f"b_{c}") for c in _CARRIED]), "b")
    stronger = F.struct(F.col("a_nums").isNotNull(), "a_n", "a") > F.struct(F.col("b_nums").isNotNull(), "b_n", "b")
    pick = lambda x, y: F.when(stronger, F.col(x)).otherwise(F.col(y))
    sides = [*[pick(f"b_{c}", f"a_{c}").alias(c) for c in _CARRIED], *[pick(f"a_{c}", f"b_{c}").alias(f"l_{c}") for c in _CARRIED], pick("b", "a").alias("g"), pick("a", "b").alias("l_g")]
    return pairs.select(F.lit(_SURNAME[0]).alias("rule"), *sides, "distance")


def _rated(found: DataFrame, rules: list[tuple[str, tuple[str, ...], int, str]]) -> Kept:
    """Links of rules, written, with their rule's order and whether what labels it is ``known`` of both and ``agree``s."""
    by_middle = F.col("rule").isin([r for r, _, _, label in rules if label == "middle"])
    both_middle, both_numbers = (F.col("middle") != 0) & (F.col("l_middle") != 0), F.col("nums").isNotNull() & F.col("l_nums").isNotNull()
    known, agree = F.when(by_middle, both_middle).otherwise(both_numbers), F.when(by_middle, F.col("middle") == F.col("l_middle")).otherwise(~number_conflict("", "l_"))
    order = F.coalesce(*[F.when(F.col("rule") == r, F.lit(i)) for i, (r, *_) in enumerate(rules)]).alias("order")
    return Kept(found.select("g", F.col("l_g").alias("parent"), "rule", order, "distance", "l_n", known.alias("known"), agree.alias("agree")))


def group_names(base: DataFrame) -> DataFrame:
    """Groups of parsed records with the same surname, given name, suffix and state (0 for none), with all their numbers (null for none).

    Groups are numbered, ``g``, when they are written, so two never share a number.
    """
    rows = _named(base).select(*_NAME, "allotment", F.ascii("middle").alias("middle"))
    # Each task sends one row per name, so the rows of a frequent name don't meet in one task.
    groups = rows.groupBy(*_NAME).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("allotment")).alias("nums"), F.count("allotment").alias("numbers"), F.max("middle").alias("middle"))
    groups = groups.withColumn("nums", F.when(F.size("nums") > 0, F.col("nums"))).withColumn("g", F.monotonically_increasing_id())
    return Kept(groups).df


def _named(base: DataFrame) -> DataFrame:
    """Parsed records with a given name, their state as a number."""
    return base.where("given != ''").withColumn("state", F.coalesce(_code("state"), F.lit(0)))


#: Rules for records with an initial only: (rule, key, what labels it), the stronger first.
_INITIALS = [
    ("initial_number", ("surname", "initial", "suffix", "allotment"), "middle"), ("initial_number_state", ("allotment", "initial", "suffix", "state"), "middle"),
    ("initial_middle", ("surname", "initial", "middle", "suffix"), "number"), ("initial", ("surname", "initial", "suffix"), "number"),
]


def link_initials(base: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last pass, records with an initial only: the one person under weaker and weaker keys. Links (src, id, person, rule) and labels (rule, known, agree)."""
    columns = ["src", "id", "surname", "initial", "middle", "suffix", "allotment", "state"]
    initials = Kept(base.where("given = '' AND initial != ''").withColumn("middle", F.ascii("middle")).withColumn("state", F.coalesce(_code("state"), F.lit(0))).select(*columns)).df

    def keyed(df: DataFrame) -> DataFrame:
        """A row per rule with its key; a null allotment or no middle initial makes no key."""
        made = []
        for i, (rule, key, _) in enumerate(_INITIALS):
            usable = F.lit(True)
            if "allotment" in key:
                usable = usable & F.col("allotment").isNotNull()
            if "middle" in key:
                usable = usable & (F.col("middle") != 0)
            made.append(F.struct(F.lit(i).alias("order"), F.when(usable, F.xxhash64(F.lit(rule), *key)).alias("key")))
        return df.withColumn("k", F.explode(F.array(*made))).where("k.key IS NOT NULL").select("k.order", "k.key", *df.columns)

    asked = keyed(initials)
    heads = people.withColumn("initial", F.substring("given", 1, 1)).withColumn("allotment", F.explode_outer("nums")).select("person", "surname", "initial", "suffix", "state", "middle", "allotment", F.col("nums").isNotNull().alias("numbered"))
    # Only the keys that records ask for; of a key's people the first and the last, which are one if it is unique.
    wanted = Kept(asked.select("key").distinct()).df
    one = keyed(heads).join(small(wanted), "key", "left_semi").groupBy("order", "key").agg(
        F.min("person").alias("person"), F.max("person").alias("other"), F.max("middle").alias("p_middle"), F.min("surname").alias("p_surname"), F.max("numbered").alias("numbered"), F.collect_set("allotment").alias("held")
    )
    found = asked.join(one.where("person = other").drop("other"), ["order", "key"])
    rule = F.array(*[F.lit(r) for r, _, _ in _INITIALS])[F.col("order")]
    found = found.where((F.col("order") != 1) | (F.levenshtein("surname", "p_surname", 2) >= 0))
    m_known, m_agree = (F.col("middle") != 0) & (F.col("p_middle") != 0), F.col("middle") == F.col("p_middle")
    n_known, n_agree = F.col("allotment").isNotNull() & F.col("numbered"), F.array_contains("held", F.col("allotment"))
    by_middle = F.col("order") < 2
    known, agree = F.when(by_middle, m_known).otherwise(n_known), F.coalesce(F.when(by_middle, m_agree).otherwise(n_agree), F.lit(False))
    found = Kept(found.where(by_middle | ~m_known | m_agree).select("src", "id", "person", "order", rule.alias("rule"), known.alias("known"), agree.alias("agree"))).df
    done = found.where("agree OR NOT known").groupBy("src", "id").agg(F.min_by(F.struct("person", "rule"), "order").alias("b")).select("src", "id", "b.person", "b.rule")
    done = Kept(done).df
    # Initials nobody was found for still match each other under one spelling and number.
    key = ["surname", "initial", "suffix", "allotment"]
    alone = initials.where("allotment IS NOT NULL").join(done, ["src", "id"], "left_anti")
    persons = Kept(alone.select(*key).distinct().withColumn("person", -1 - F.monotonically_increasing_id())).df  # below all groups' numbers
    return done.unionByName(alone.join(small(persons), key).select("src", "id", "person", F.lit("initial_number").alias("rule"))), found.select("rule", "known", "agree")


def _tops(linked: DataFrame) -> DataFrame:
    """Links (g, parent, rule) followed to their ends; each round doubles the steps taken."""
    now = Kept(linked).df
    while True:
        up = now.select(F.col("g").alias("parent"), F.col("parent").alias("above"))
        after = Kept(now.join(up, "parent", "left").select("g", F.coalesce("above", "parent").alias("parent"), "rule", F.col("above").isNotNull().alias("moved"))).df
        if not after.where("moved").head(1):
            return now
        now = after.drop("moved")


def resolve(all_records: DataFrame, words: NameWords = NameWords()) -> tuple[DataFrame, DataFrame]:
    """Records (src, id, person, rule), and (rule, labelled, agreeing, precision) of every rule."""
    base = finished(lambda: parsed(all_records, words))
    groups = group_names(base)
    slices = SLICES if groups.count() > SLICED else 1
    open_, counts, linked, best = groups, [], None, None
    # A pass is tried on all groups, so that its labels don't depend on what the passes before it left; so the keys of all exact passes are laid out at once.
    for passes, find in ((_PASSES, lambda rules: _joined(groups, rules)), ([[_SURNAME]], lambda rules: _by_surname(groups, slices))):
        tried = [rule for rules in passes for rule in rules]
        written = _rated(find(tried), tried)
        # Groups that share several numbers met several times under one rule.
        links = written.df.where("known").groupBy("rule", "g", "parent").agg(F.max("agree").alias("agree"))
        counts.append(Kept(links.groupBy("rule").agg(F.count("*").alias("labelled"), F.sum(F.col("agree").cast("long")).alias("agreeing"))).df)
        for rules in passes:
            links = written.df.where(F.col("rule").isin([r for r, *_ in rules]) & F.expr("agree OR NOT known"))
            if best is not None:
                open_ = Kept(open_.select("g").join(best, "g", "left_anti")).df
                links = links.join(open_, "g", "left_semi")
            best = Kept(links.groupBy("g").agg(F.min_by(F.struct("parent", "rule"), F.struct("order", "distance", -F.col("l_n"), "parent")).alias("b")).select("g", "b.parent", "b.rule")).df
            linked = best if linked is None else linked.unionByName(best)
        written.drop()
    top = _tops(linked)
    people = groups.join(top, "g", "left").select("g", F.coalesce("parent", "g").alias("person"), F.coalesce("rule", F.lit("name")).alias("rule"), "surname", "given", "suffix", "n", "nums", "middle", "state")
    people = Kept(people).df
    done = _named(base).select("src", "id", *_NAME).join(people.select(*_NAME, "person", "rule").hint("shuffle_hash"), _NAME).select("src", "id", "person", "rule")

    weak, labels = link_initials(base, people)
    done = done.unionByName(weak)
    labels = labels.where("known").groupBy("rule").agg(F.count("*").alias("labelled"), F.sum(F.col("agree").cast("long")).alias("agreeing"))
    labels = reduce(DataFrame.unionByName, counts, labels)
    same = groups.where("numbers > 1").agg(F.lit("name").alias("rule"), F.count("*").alias("labelled"), F.coalesce(F.sum((F.size("nums") == 1).cast("long")), F.lit(0)).alias("agreeing"))
    labels = labels.unionByName(same).groupBy("rule").agg(F.sum("labelled").alias("labelled"), F.sum("agreeing").alias("agreeing"))
    return done, labels.withColumn("precision", (F.coalesce("agreeing", F.lit(0)) + 1) / (F.col("labelled") + 2))


def match(left: DataFrame, right: DataFrame, left_src: str, right_src: str, words: NameWords = NameWords()) -> DataFrame:
    """Pairs (left_id, right_id, rule, confidence) of records (see ``records``) of the same person."""
    done, labels = resolve(left.unionByName(right), words)
    a = done.where(F.col("src") == left_src).select(F.col("id").alias("left_id"), "person", F.col("rule").alias("l_rule"))
    b = done.where(F.col("src") == right_src).select(F.col("id").alias("right_id"), "person", F.col("rule").alias("r_rule"))
    rates = F.broadcast(labels.select("rule", "precision"))  # one row per rule
    l_rate, r_rate = rates.select(F.col("rule").alias("l_rule"), F.col("precision").alias("lp")), rates.select(F.col("rule").alias("r_rule"), F.col("precision").alias("rp"))
    out = a.join(b, "person").join(F.broadcast(l_rate), "l_rule", "left").join(F.broadcast(r_rate), "r_rule", "left")
    lp, rp = F.coalesce("lp", F.lit(0.5)), F.coalesce("rp", F.lit(0.5))
    return out.select("left_id", "right_id", F.when(lp <= rp, F.col("l_rule")).otherwise(F.col("r_rule")).alias("rule"), F.least(lp, rp).alias("confidence"))
