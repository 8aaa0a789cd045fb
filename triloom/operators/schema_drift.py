"""Fields that are renamed, retyped, added or removed from file to file.

Every JSON object has a schema tree: names, nesting and kinds of value. Files share few
distinct trees, so the trees are found first (an aggregate), each is matched with the
reference once, and the result is joined back to the files.

Matching is similarity flooding (Melnik, Garcia-Molina, Rahm 2002). The tree of a file
and the reference tree are graphs: an object has members; a member has a name, a kind
and, at the top, a profile of the forms its values take in all files; a name has words.
Their pairs make one graph, in which a pair feeds the pairs it shares an edge with. Only
pairs of words, kinds and profiles start with a score of their own; what a pair of
members is worth comes from the flow alone, which goes on until nothing changes any
more. The coefficients of the pairs that feed one pair sum up to less than 1 with all
its feedback, so there is one fixpoint and scores of different trees are comparable. A
field that stands under its own name is matched with itself; the others are matched by
the final scores, one to one and best first (a stable marriage, since both sides rank by
the same score), as far as the final score reaches ``LEAST``.

Defined results: texts that are no complete JSON object have no tree and no changes; a
null or an empty list fits any kind; whole and decimal numbers are one kind; an object
that only carries a renamed field is not an added field; a name that occurs twice in an
object makes the object incomplete.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.runtime import cut

NUM, TEXT, NUM_LIST, LIST_LIST = "number", "text", "list<number>", "list<list>"

#: The reference fields of the two origins, and the kind of each.
INIT_META: dict[str, str] = {
    "id": TEXT, "shape": TEXT, "sizes": NUM_LIST, "zs": NUM_LIST, "n": NUM, "rings": NUM, "overlap_pct": NUM,
    "overlap": NUM, "run": NUM, "seed": NUM, "n_actual": NUM, "M_actual": NUM, "k_step": NUM, "p_step": NUM,
    "t_step": NUM, "n_p": NUM, "n_t": NUM, "merged_pairs": LIST_LIST,
}
P_SWEEP: dict[str, str] = {k: NUM for k in ("overlap", "n", "z", "ring_size", "t_best", "p", "score")}

#: Words that make another quantity of the field they stand beside: a name with one is no name of the field itself.
STATISTICS = frozenset({"std", "var", "mean", "avg", "min", "max", "median", "err", "error", "sum", "total"})
#: The least final score of a match.
LEAST = 0.43
#: How much of the score of a pair of names, kinds, profiles and carriers a pair of members takes up, and how much of its own it gives back.
FROM_NAME, FROM_KIND, FROM_PROFILE, FROM_CARRIER, BACK = 0.45, 0.25, 0.3, 0.1, 0.1
#: Profiles that have less than this in common say nothing.
FAINT = 0.05


# -- trees ----------------------------------------------------------------------


def kind_signature(schema: F.Column) -> F.Column:
    """The tree of a VARIANT object as text, from its schema, with all numbers of one kind."""
    return F.regexp_replace(schema, r"\b(?:BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL\([0-9]+,\s*[0-9]+\))(?=[,>]|$)", "NUM")


@lru_cache(maxsize=20_000)
def parse_tree(signature: str) -> tuple[tuple[tuple[str, ...], str], ...]:
    """(path, kind) of every member of the object, parents before children."""
    out: list[tuple[tuple[str, ...], str]] = []
    pos = 0

    def name() -> str:
        nonlocal pos
        if signature[pos] == "`":
            m = re.compile(r"`((?:[^`]|``)*)`").match(signature, pos)
            pos = m.end()
            return m[1].replace("``", "`")
        m = re.compile(r"[^:]*").match(signature, pos)
        pos = m.end()
        return m[0]

    def value(path: tuple[str, ...]) -> str:
        nonlocal pos
        word = re.compile(r"[A-Z_ ]+(?:\([^)]*\))?").match(signature, pos)
        pos = word.end()
        w = word[0].strip()
        if w == "OBJECT":
            pos += 1
            while signature[pos] != ">":
                key = name()
                pos += 1
                while signature[pos] == " ":
                    pos += 1
                here = len(out)
                out.append(((*path, key), ""))
                out[here] = ((*path, key), value((*path, key)))
                while signature[pos] in ", ":
                    pos += 1
            pos += 1
            return "object"
        if w == "ARRAY":
            pos += 1
            before = len(out)
            inner = value((*path, "[]"))
            del out[before:]  # objects inside lists are values, not fields
            pos += 1
            return "list<" + (inner if not inner.startswith("list") else "list") + ">" if inner != "null" else "list<>"
        return {"NUM": NUM, "STRING": TEXT, "BOOLEAN": "boolean", "VOID": "null"}.get(w, w.lower())

    value(())
    return tuple(out)


def fits(kind: str, reference: str) -> bool:
    return kind in ("null", "list<>") or kind == reference


# -- likeness of words and kinds ---------------------------------------------------


@lru_cache(maxsize=100_000)
def words(name: str) -> tuple[str, ...]:
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name)
    found = [w.lower() for w in re.split(r"[^A-Za-z0-9]+", spaced) if w]
    return tuple(w[:-1] if len(w) > 2 and w.endswith("s") and not w.endswith("ss") else w for w in found)


def word_likeness(a: str, b: str) -> float:
    """1 for equal words, 0.5 to 1 where the letters of one stand in order in the other, which begins alike."""
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if len(short) < 2 or long[0] != short[0] or not (len(short) > 2 or long.startswith(short)):
        return 0.0
    rest = iter(long)
    return 0.5 + 0.5 * len(short) / len(long) if all(ch in rest for ch in short) else 0.0


def kind_likeness(kind: str, reference: str) -> float:
    if fits(kind, reference):
        return 1.0
    if kind.startswith("list") and reference.startswith("list"):
        return 0.8
    if kind == TEXT:
        return 0.7  # anything can be written as text
    if kind == "object" and reference != NUM:
        return 0.3
    return 0.5 if kind.startswith("list") else 0.0


# -- similarity flooding -----------------------------------------------------------

Path = tuple[str, ...]


class _Pairs:
    """The graph of pairs: start scores, and who feeds whom with what coefficient."""

    def __init__(self):
        self.at: dict[tuple, int] = {}
        self.start: list[float] = []
        self.flows: dict[tuple[int, int], float] = {}

    def pair(self, *key, start: float = 0.0) -> int:
        i = self.at.setdefault(key, len(self.start))
        if i == len(self.start):
            self.start.append(start)
        return i

    def feed(self, source: int, target: int, coefficient: float) -> None:
        self.flows[source, target] = coefficient

    def fixpoint(self, eps: float = 1e-6) -> np.ndarray:
        ends = np.array(list(self.flows), dtype=np.int64).reshape(-1, 2)
        share = np.array(list(self.flows.values()))
        start = np.array(self.start)
        now = start
        while True:
            new = start + np.bincount(ends[:, 1], weights=share * now[ends[:, 0]], minlength=len(start))
            if np.abs(new - now).max(initial=0.0) < eps:
                return new
            now = new


@lru_cache(maxsize=20_000)
def flood(members: tuple[tuple[Path, str], ...], fields: tuple[tuple[str, str], ...], profiles: tuple[tuple[str, str, float], ...]) -> dict[tuple[Path, str], float]:
    """Final scores of all pairs of a member (path) of a tree and a field of the reference.

    ``profiles`` has what the values of a top member and of a field have in common.
    """
    g = _Pairs()
    g.pair("carrier", (), start=0.5)
    for path, kind in members:
        for field, wanted in fields:
            here = g.pair("member", path, field)
            if like := kind_likeness(kind, wanted):
                g.feed(g.pair("kind", kind, wanted, start=like), here, FROM_KIND)
            a, b = words(path[-1]), words(field)
            if STATISTICS & set(a) == STATISTICS & set(b):
                for x, y in product(a, b):
                    if like := word_likeness(x, y):
                        name = g.pair("name", path[-1], field)
                        g.feed(g.pair("word", x, y, start=like), name, 2 / (len(a) + len(b)))
                        g.feed(name, here, FROM_NAME)
                        g.feed(here, name, BACK)
            carrier = g.pair("carrier", path[:-1])
            g.feed(carrier, here, FROM_CARRIER)
            g.feed(here, carrier, BACK / len(fields))
    for key, field, like in profiles:
        if ("member", (key,), field) in g.at:
            g.feed(g.pair("profile", key, field, start=like), g.at["member", (key,), field], FROM_PROFILE)
    scores = g.fixpoint()
    return {(k[1], k[2]): float(scores[i]) for k, i in g.at.items() if k[0] == "member"}


def correspondences(
    tree: Sequence[tuple[Path, str]], reference: Mapping[str, str], profiles: Iterable[tuple[str, str, float]] = (), least: float = LEAST
) -> dict[str, Path]:
    """field -> path, one to one, by the flooded scores of at least ``least``."""
    kinds = dict(tree)
    found = {f: (f,) for f in reference if (f,) in kinds}
    own = set(found.values())
    members = tuple((p, k) for p, k in tree if p[:1] not in own)
    fields = tuple((f, k) for f, k in reference.items() if f not in found)
    if not members or not fields:
        return found
    scores = flood(members, fields, tuple(sorted(profiles)))
    taken: list[Path] = []
    for score, _, p, f in sorted((-round(s, 6), len(p), p, f) for (p, f), s in scores.items()):
        if -score < least:
            break
        if f not in found and not any(p[: len(t)] == t or t[: len(p)] == p for t in taken):
            found[f] = p
            taken.append(p)
    return found


def tree_changes(tree: Sequence[tuple[Path, str]], reference: Mapping[str, str], profiles: Iterable[tuple[str, str, float]] = ()) -> tuple[dict, list[tuple[str, str]]]:
    kinds = dict(tree)
    found = correspondences(tree, reference, profiles)
    changes = []
    for f, kind in reference.items():
        if f not in found:
            changes.append((f, "removed"))
            continue
        if found[f] != (f,):
            changes.append((f, "renamed"))
        if not fits(kinds[found[f]], kind):
            changes.append((f, "retyped"))
    carriers = {p[0] for p in found.values()}
    changes += [(p[0], "added") for p, _ in tree if len(p) == 1 and p[0] not in carriers]
    return found, changes


# -- Spark -------------------------------------------------------------------------

_MATCHED = "signature string, field_paths map<string,string>, changes array<struct<field:string,change:string>>"


def json_path(path: Sequence[str]) -> str:
    return "$" + "".join("['" + p.replace("'", "\\'") + "']" for p in path)


def signed(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose ``text`` is one complete JSON object, with ``__object`` and the ``__signature`` of its tree.

    Each text is parsed once, as the only element of a list, so that anything after the
    object makes it incomplete.
    """
    listed = rows.withColumn("__list", F.try_parse_json(F.concat(F.lit("["), F.col(text), F.lit("]"))))
    single = listed.withColumn("__object", F.when(F.variant_get("__list", "$[1]", "variant").isNull(), F.variant_get("__list", "$[0]", "variant")))
    schema = single.withColumn("__schema", F.schema_of_variant("__object")).where(F.col("__schema").startswith("OBJECT"))
    return schema.withColumn("__signature", kind_signature(F.col("__schema"))).drop("__list", "__schema")


def value_form(value: F.Column) -> F.Column:
    """The form of a value: whole numbers of up to four digits stand for themselves, otherwise digits are 9 (but a leading 0)
    and words are a; lists by the forms of their elements. Null for a value that says nothing (null, blank, empty list)."""
    form = F.regexp_replace(F.regexp_replace(value, r"(?<!^)[0-9]|^[1-9]", "9"), r"\p{L}+", "a")
    form = F.when(value.rlike(r"^[\[{]"), F.regexp_replace(form, r"\b9+(?:, ?9+)*\b", "9")).when(value.rlike(r"^[0-9]{1,4}$"), value).otherwise(form)
    return F.when(~value.rlike(r"^[\s\[\]]*$"), form)


def value_forms(variant: str) -> F.Column:
    """(key, form) of the top members of an object."""
    entries = F.map_entries(F.try_variant_get(variant, "$", "map<string,string>"))
    return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), value_form(e["value"]).alias("form")))


def profile_likeness(counted: DataFrame, reference: Mapping[str, str]) -> DataFrame:
    """key, field, likeness: how much the forms of a member that is no reference field have in common with those of a field.

    ``counted`` has forms (see ``value_forms``) and c, how often they occur. Only keys and
    forms are joined, after they were counted.
    """
    forms = counted.select(F.inline("forms"), "c").where("form IS NOT NULL").groupBy("key", "form").agg(F.sum("c").alias("c"))
    totals = forms.groupBy("key").agg(F.sum("c").alias("t"))
    shares = forms.join(totals, "key").select("key", "form", (F.col("c") / F.col("t")).alias("share"))
    known = F.col("key").isin(*reference)
    fields = shares.where(known).select(F.col("key").alias("field"), "form", F.col("share").alias("usual"))
    met = shares.where(~known).join(fields, "form").groupBy("key", "field").agg(F.sum(F.least("share", "usual")).alias("likeness"))
    return met.where(F.col("likeness") >= F.lit(FAINT))


def match_signatures(counted: DataFrame, reference: Mapping[str, str]) -> DataFrame:
    """The distinct trees (signature) of ``counted`` (signature, forms, c) with their correspondences and changes."""
    reference = dict(reference)
    # members that are no reference field, by tree: few, and counted before they are shuffled
    others = counted.select("signature", F.explode(F.array_distinct(F.transform("forms", lambda e: e["key"]))).alias("key"))
    others = others.where(~F.col("key").isin(*reference)).distinct()
    profiles = others.join(profile_likeness(counted, reference), "key").groupBy("signature").agg(
        F.collect_list(F.struct("key", "field", F.round("likeness", 6).alias("likeness"))).alias("profiles")
    )
    trees = counted.select("signature").distinct().join(profiles, "signature", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for sig, evidence in zip(b["signature"], b["profiles"]):
                evidence = [] if evidence is None else [(e["key"], e["field"], e["likeness"]) for e in evidence]
                found, changes = tree_changes(parse_tree(sig), reference, evidence)
                paths = {f: json_path(p) for f, p in found.items()}
                rows.append((sig, paths, [{"field": f, "change": c} for f, c in changes]))
            yield pd.DataFrame(rows, columns=["signature", "field_paths", "changes"])

    return trees.mapInPandas(run, _MATCHED)


def drift_report(rows: DataFrame, file_id: str, text: str, reference: Mapping[str, str], origin: str) -> DataFrame:
    """origin, file_id, field, change: every departure of a file from the reference.

    A file of several rows shows a change if any of its rows does; a field is removed
    from it only if it is removed from all of them. The texts are read and parsed once.
    """
    one = signed(rows.select(F.col(file_id).alias("file_id"), F.col(text).alias("__text")), "__text")
    one = one.select("file_id", F.col("__signature").alias("signature"), value_forms("__object").alias("forms"))
    counted = cut(one.groupBy("file_id", "signature", "forms").agg(F.count(F.lit(1)).alias("c")))
    matched = match_signatures(counted, reference).select("signature", "changes").where(F.size("changes") > 0)
    per_file = counted.groupBy("file_id", "signature").agg(F.sum("c").alias("c"))
    total = per_file.groupBy("file_id").agg(F.sum("c").alias("total"))
    changes = per_file.join(matched, "signature").select("file_id", "c", F.inline("changes"))
    found = changes.groupBy("file_id", "field", "change").agg(F.sum("c").alias("c"))
    return (
        found.join(total, "file_id")
        .where("change <> 'removed' OR c = total")
        .select(F.lit(origin).alias("origin"), "file_id", "field", "change")
    )


def _number(raw: F.Column, path: F.Column, form: str | None) -> F.Column:
    """A number written as number, text, ``[x]`` or with a decimal comma, and in the ways of its form."""
    bare = F.regexp_replace(F.regexp_replace(raw, r'[\[\]"\s%]', ""), ",", ".")
    v = bare.try_cast("double")
    if form == "fraction":
        return F.when(raw.contains("%") | path.rlike(r"(?i)(pct|percent)'\]$"), v / 100).otherwise(v)
    if form == "hexadecimal":
        return F.when(raw.rlike("^[0-9a-fA-F]{8}$") & raw.rlike("[a-fA-F]"), F.conv(raw, 16, 10).cast("double")).otherwise(v)
    return v


def unify(rows: DataFrame, text: str, reference: Mapping[str, str], keep: Sequence[str], forms: Mapping[str, str] | None = None) -> DataFrame:
    """One consistent table: the columns ``keep`` and every reference field in its kind.

    Numbers become double, lists of numbers array<double>, lists of lists stay JSON
    text; a value that cannot be cast is null. ``forms`` says in what other ways a field
    may be written: ``fraction`` (percentages are divided by 100), ``hexadecimal`` (a number
    in eight digits), ``named`` (a text inside an object or list).
    """
    forms = forms or {}
    one = signed(rows.select(*keep, F.col(text).alias("__text")), "__text")
    seen = one.select(F.col("__signature").alias("signature"), value_forms("__object").alias("forms"))
    counted = cut(seen.groupBy("signature", "forms").agg(F.count(F.lit(1)).alias("c")))
    matched = match_signatures(counted, reference).select(F.col("signature").alias("__signature"), F.col("field_paths").alias("__paths"))
    m = one.drop("__object").join(matched, "__signature")
    cols = []
    for f, kind in reference.items():
        path = F.col("__paths")[f]
        raw = F.call_function("get_json_object", F.col("__text"), path)
        if kind == NUM:
            v = _number(raw, path, forms.get(f))
        elif kind == NUM_LIST:
            nums = F.regexp_extract_all(F.regexp_replace(raw, r'"[A-Za-z_]\w*"\s*:', ""), F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), 1)
            v = F.transform(nums, lambda x: x.cast("double"))
        elif forms.get(f) == "named":
            v = F.coalesce(F.get_json_object(raw, "$.name"), F.get_json_object(raw, "$[0]"), raw)
        else:
            v = raw
        cols.append(v.alias(f))
    return m.select(*keep, *cols)
