"""Splits, percentiles, packing, mixing and sentences against brute force and on dirty rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from triloom.llm import mixing as M
from triloom.llm import packing as P
from triloom.llm import quantiles as Q
from triloom.llm import sentences as S
from triloom.llm.splits import QUARANTINE, SplitStore
from triloom.llm.tokens import count_tokens, token_count
from triloom.runtime import cut, new_table_dir

TOK = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


# -- tokens --------------------------------------------------------------------------


def test_tokens(spark):
    long = "word " * 60_000 + "x" * 250_000
    df = spark.createDataFrame([("hello world",), ("",), (None,), (long,), ("<|endoftext|>",), ("퟿",)], "text string")
    got = [r[0] for r in df.select(token_count("text").alias("n")).collect()]
    assert got[1:3] == [0, None]
    assert got[0] == count_tokens("hello world", TOK)
    assert got[3] > 60_000
    assert got[4] > 1


# -- 2: splits -----------------------------------------------------------------------


def brute_groups(rows):
    group = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        low = {}
        for i, keys in rows:
            for k in keys or []:
                if k is not None:
                    low[k] = min(low.get(k, 10**9), group[i])
        for i, keys in rows:
            g = min([group[i], *[low[k] for k in keys or [] if k is not None]])
            if g < group[i]:
                group[i], changed = g, True
    return group


def test_splits_follow_components(spark):
    r = random.Random(3)
    rows = [(i, [f"a{r.randrange(60)}" if r.random() < 0.9 else None, f"b{r.randrange(150)}", None]) for i in range(200)]
    rows += [(i, ["hot"]) for i in range(200, 300)] + [(300, []), (301, None)]
    df = spark.createDataFrame(rows, "id bigint, keys array<string>")
    for edges in ((0, 400), (0, 120, 250, 400), (0, 30, 60, 100, 140, 280, 400)):
        path = new_table_dir(spark, "splits")
        for a, b in zip(edges, edges[1:]):
            s = SplitStore(spark, path, most_parts=2)  # opened again for every batch
            s.update(df.where((F.col("id") >= a) & (F.col("id") < b)), f"{a}")
            weights = {}
            for x in s.assigned().collect():
                weights[x["split"]] = weights.get(x["split"], 0) + 1
            assert {k: v for k, v in s.state()["weights"].items() if v} == weights
        got = {x["id"]: x for x in s.assigned().collect()}
        want = brute_groups(rows)
        assert {i: x["comp"] for i, x in got.items()} == want
        by = {}
        for x in got.values():
            by.setdefault(x["comp"], set()).add(x["split"])
        assert all(len(v) == 1 for v in by.values())


def test_splits_are_kept_and_conflicts_quarantined(spark):
    s = SplitStore(spark, new_table_dir(spark, "splits"), {"train": 0.5, "test": 0.5})
    first = spark.createDataFrame([(i, [f"k{i}"]) for i in range(100)], "id bigint, keys array<string>")
    s.update(first, "first")
    before = {r["id"]: r["split"] for r in s.assigned().collect()}
    assert 45 <= sum(v == "train" for v in before.values()) <= 55
    a = next(i for i, v in before.items() if v == "train")
    b = next(i for i, v in before.items() if v == "test")
    c = next(i for i, v in before.items() if v == "train" and i != a)
    s.update(spark.createDataFrame([(200, [f"k{a}", f"k{b}"]), (201, [f"k{c}"]), (202, ["new"]), (a, ["extra"])], "id bigint, keys array<string>"), "second")
    after = {r["id"]: r["split"] for r in s.assigned().collect()}
    assert after[a] == after[b] == after[200] == QUARANTINE
    assert after[201] == before[c] == after[c]
    assert after[202] in ("train", "test")
    assert all(after[i] == v for i, v in before.items() if i not in (a, b))
    s.update(first.where("id < 0"), "nothing")
    s.update(first.select((F.col("id") + 900).alias("id"), "keys"), "first")
    assert {r["id"]: r["split"] for r in s.assigned().collect()} == after
    assert SplitStore(spark, new_table_dir(spark, "splits")).assigned().count() == 0
    with pytest.raises(ValueError):
        SplitStore(spark, "nowhere", {})


# -- 5: percentiles ------------------------------------------------------------------


def rank_error(values, v, q):
    x = np.sort(values)
    r = max(1, math.ceil(q * len(x) - 1e-9))
    lo, hi = np.searchsorted(x, v, "left") + 1, np.searchsorted(x, v, "right")
    return max(0, lo - r, r - hi)


@pytest.mark.parametrize("kind", ["uniform", "ties", "heavy", "sorted"])
def test_collapsing_stays_within_its_bound(kind):
    rng = np.random.default_rng(1)
    x = {"uniform": rng.random(60_000), "ties": rng.integers(0, 5, 60_000).astype(float), "heavy": rng.pareto(0.5, 60_000), "sorted": np.arange(60_000.0)}[kind]
    parts = [Q.Sketch(40) for _ in range(5)]
    for s, p in zip(parts, np.array_split(x, 5)):
        for c in np.array_split(p, 37):
            s.add(c)
    rows = [r for s in parts for r in s.rows()]
    m = Q.merge_buffers([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], 40)
    out = m.rows()
    v = np.concatenate([r[3] for r in out])
    w = np.repeat([r[1] for r in out], [len(r[3]) for r in out])
    assert w.sum() == len(x)
    bound = sum(r[2] for r in out) + w.max()
    order = np.argsort(v)
    upto = np.cumsum(w[order])
    for q in (0.0, 0.01, 0.5, 0.9, 0.999, 1.0):
        r = max(1, math.ceil(q * len(x)))
        assert rank_error(x, v[order][np.searchsorted(upto, r)], q) <= bound
    assert bound < 0.1 * len(x)


def test_percentiles(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), i % 3, r.choice([None, float("nan"), r.random()]), r.random() if i % 7 else float("inf")) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, d int, x double, y double").repartition(5)
    for k in (8, Q.buffer_size()):
        daily = Q.build(df, ["d", "g"], ["x", "y"], k)
        got = Q.percentiles(Q.combine(daily, ["g"], k, merge_values=300 if k == 8 else Q.MERGE_VALUES), ["g"], [0.1, 0.5, 1.0]).collect()
        assert {(x["g"], x["metric"]) for x in got} == {(g, m) for g in ("a", "b", None) for m in "xy"}
        for x in got:
            col = 2 if x["metric"] == "x" else 3
            vals = [v[col] for v in rows if v[0] == x["g"] and v[col] is not None and v[col] == v[col]]
            assert x["n"] == len(vals)
            assert rank_error(np.array(vals), x["value"], x["q"]) <= x["max_rank_error"]
            assert k == 8 or x["max_rank_error"] == 0
    none = df.where("g = 'q'")
    assert Q.percentiles(Q.combine(Q.build(none, ["g"], ["x"], 8), ["g"], 8), ["g"], [0.5]).count() == 0
    assert (math.log(Q.MOST / Q.buffer_size(), Q.FAN) / 2 + 1) / Q.buffer_size() <= Q.EPS


# -- 6: packing ----------------------------------------------------------------------


def test_assignment_is_lowest_cost_with_room():
    r = random.Random(4)
    n = np.array([r.randrange(1, 65) for _ in range(400)])
    got = P.assign_sequences(n, 64)
    room, cost = [64] * max(1, -(-int(n.sum()) // 64)), [0.0] * max(1, -(-int(n.sum()) // 64))
    for k in np.argsort(-n, kind="stable"):
        fit = [(cost[i], i) for i in range(len(room)) if room[i] >= n[k]]
        if fit:
            c, i = min(fit)
        else:
            i = len(room)
            room.append(64)
            cost.append(0.0)
        assert cost[got[k]] == pytest.approx(cost[i])
        i = got[k]
        room[i] -= n[k]
        cost[i] += P.LINEAR * n[k] + P.QUADRATIC * n[k] ** 2
        assert room[i] >= 0
    assert len(P.assign_sequences(np.array([], dtype=int), 8)) == 0


def test_packing(spark):
    docs = [(i, "word " * random.Random(i).randrange(1, 300)) for i in range(120)] + [(500, None), (501, ""), (None, "no id at all")] + [(7, "same words here")] * 60 + [(600, "long " * 9000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, pack_name string, u int")
    packs = spark.createDataFrame([("s", 128), ("l", 2048), ("none", None), ("zero", 0)], "pack_name string, capacity_tokens int")
    sized = P.measured(df)
    placed = cut(P.pack(sized, packs, shard_tokens=8000))
    tokens = sorted(r["n_tokens"] for r in sized.collect())
    for name, cap in (("s", 128), ("l", 2048)):
        rows = placed.where(F.col("pack_name") == name).collect()
        used, by_doc = {}, {}
        for r in rows:
            used.setdefault(r["container_id"], []).append((r["start_token"], r["n_tokens"]))
            by_doc.setdefault(r["doc_id"], []).append(r["n_tokens"])
        for pieces in used.values():
            at = 0
            for s, n in sorted(pieces):
                assert s == at
                at += n
            assert at <= cap
        assert sum(r["n_tokens"] for r in rows) == sum(tokens)
        whole = [r for r in rows if r["n_tokens"] < cap and r["piece_no"] == 0]
        assert all(n in tokens for n in {r["n_tokens"] for r in whole})
        assert max(r["piece_no"] for r in rows) == (max(tokens) - 1) // cap
    report = {r["pack_name"]: r for r in P.packing_report(placed, packs).collect()}
    assert set(report) == {"s", "l"}
    assert report["s"]["unused_share"] < 0.1
    empty = P.measured(df.where("doc_id < 0"))
    assert P.pack(empty, packs).count() == 0
    assert P.pack(sized, packs.where("pack_name = 'q'")).count() == 0


# -- 7: mixing -----------------------------------------------------------------------


def test_mixture(spark):
    r = random.Random(8)
    docs = [(i, r.choice(["Forum", " forum ", "FORUM"]) if i % 3 else "big-source", "word " * r.randrange(1, 40)) for i in range(1500)]
    docs += [(9001 + i, "tiny", "some words") for i in range(5)] + [(1, None, "x"), (2, "unlisted", "x"), (3, "forum", None), (4, "forum", "")]
    df = spark.createDataFrame([(i, s, t, "x") for i, s, t in docs], "doc_id bigint, source string, text string, weight string")
    targets = spark.createDataFrame(
        [("forum", 0.6, 2), ("big_source", 0.3, 1), ("tiny", 0.05, 3), ("absent", 0.05, 4), ("nothing", None, 1), ("never", 0.1, 0), (None, 0.1, 1), ("forum ", 0.1, 1)],
        "source string, target_share double, max_repeats int",
    )
    sized = M.measured(df)
    for budget in (None, 4000, 10**9):
        mix = cut(M.mix(sized, targets, budget))
        rows = mix.orderBy("running_tokens").collect()
        total = sum(x["n_tokens"] for x in rows)
        assert rows[-1]["running_tokens"] == total
        assert [x["finish_time"] for x in rows] == sorted(x["finish_time"] for x in rows)
        uses = {}
        for x in rows:
            uses.setdefault((x["source"], x["doc_id"]), []).append(x["pass_no"])
        limit = {"forum": 2, "big_source": 1, "tiny": 3}
        assert all(len(v) == len(set(v)) and len(v) <= limit[k[0]] for k, v in uses.items())
        shares = {x["source"]: x for x in M.mixture_shares(mix, sized, targets).collect()}
        if budget == 4000:
            assert total <= 4000 < total + 60
            assert shares["big_source"]["actual_share"] / shares["forum"]["actual_share"] == pytest.approx(0.5, rel=0.1)
        if budget == 10**9:
            assert shares["tiny"]["documents_used"] == 15
        assert shares["absent"]["actual_share"] == 0
    assert M.mix(M.measured(df.where("doc_id < 0")), targets).count() == 0
    assert M.mix(sized, targets.where("source = 'q'")).count() == 0


def test_virtual_end_is_water_filling():
    s = lambda w, r, t: M.Share("s", "s", w, r, t, 1, 1)
    shares = [s(0.5, 1, 100), s(0.3, 2, 300), s(0.2, 4, 10)]
    for budget in (10, 150, 400, 700):
        v = M.virtual_end(shares, budget)
        assert sum(min(x.weight * v, x.repeats * x.tokens) for x in shares) == pytest.approx(budget)


# -- 8: sentences --------------------------------------------------------------------

CASES = [
    "Dr. Brindwick thinks that the edge is 8.3.1 wide.| Who knows, e.g. No. 9?| See Fig. 7 and Sec. 2 about seeds, labels etc.| The end",
    "“Is the result R69 closed?” asked Plissander.| “The log splits. Nothing else moved,” said Zeptin.| Kestwyn wrote: “The sample repeats the log!”| Next.",
    "The result F6 ... well, it limits.| Is that true ... or not?!| First the log… then the edge.| (The edge splits the log. It does.)| What a mess!!",
    "Prof. J. K. Quenlow et al. say so.|The glued one follows.| Open init_meta.json, then look at 0.5 vs. 2.",
    "Einige Schritte, z. B. Nr. 11, betreffen das Netz.| Dazu kommen Listen, Tabellen u. Ä.| Das Netz bzw. Fr. Velmora.| „Ist das alles?“, fragte Zeptin.| Ostrane schrieb: „Ja!“| Ende.",
    "Ο κ. Nockerby πιστεύει.| Κατά τον καθ. Ι. Κ. Kestwyn κ.ά. το μέτρο χωρίζει.| Είναι αλήθεια ... ή όχι;| Λίστες κ.λπ.| «Έκλεισε το όριο;» ρώτησε ο Zeptin.",
    "См. рис. 6 и гл. 8.| Г-н Fenlocke, т. е. автор, считает.| Списки и т. д.| «Закрыт ли порог?» — спрашивает Zeptin.| По мнению проф. Я. К. Tarquil и др. набор важен.",
    "डॉ. Velmora मानते हैं।| चि. 6 और पृ. 2 पर देखें।| “क्या नमूना बंद है?” Halvoren ने पूछा।| Zeptin ने कहा, “सच है। और कुछ नहीं हिला।”| समूह G1 ... खैर, छिपाता है।",
    "なぜログは変えるのか？|「閉じたか？」とZeptinは尋ねた。|Velmoraは「変える。動かない。」と書いた。|辺は……まあ、変える。|57.110%だけが残る。|（辺はログを変える。）|J. K. Zeptin博士による。",
    "Plissander说：“样本限制了。其他都没有动。”|边重复了阈值。|“关上了吗？”Fenlocke问道。|见图4.7。|网络……嗯，改变了。",
    "قال Zeptin: «القراءة تستبدل. لم يتحرك شيء» في الجولة.| تقول أ. د. Zeptin إن الوثيقة.| انظر ص. 7 والجداول إلخ.| هل هذا صحيح ... أم لا؟!| سأل Zeptin: «هل هي مغلقة؟» خلال الليل.| نعم.",
    "Ինչո՞ւ նիշքը բացատրում է։| Տե՛ս նկ. 10 և գլ. 3։| Zeptin գրում է. «Նիշքը փոխում է»։| Պրն. Ostrane կարծում է:| «Շեմը հաստատում է։ Ոչինչ չշարժվեց», ասում է Tarquil։",
    "ዶ/ር Halvoren እንደሚሉት።| ይህ እውነት ነው ... ወይስ አይደለም?| Zeptin «ቀለበቱ ይተካል። ሌላ ነገር» አሉ።| ሥዕ. 10 ይመልከቱ፡፡| መረቡ ይሸፍናል::| ቀለበቱ",
    "บันทึก M650 อธิบายตัวอย่าง| ทำไมแฟ้มจึงซ่อนการวัด| ดูรูปที่ 5 และข้อ 8 เรื่องการวัด| Zeptin กล่าวว่า “แฟ้มแบ่ง อย่างอื่นไม่ขยับ” ในรอบที่สอง| Plissander กล่าวว่า “ชุมชน” ในรอบ| ยุ่งเหยิงจริง ๆ| แฟ้มแบ่งชุมชน แต่วงแหวนซ่อน| ดร. Zeptin เชื่อว่าแฟ้ม",
    "¿La red está completa?| «¿Cerró el umbral?», preguntó Zeptin.| La Sra. Ostrane, p. ej. en cap. 7, etc.| ¡Qué lío!!| El Sr. Tarquil.",
    "Sn. Zeptin ölçer.| “Dosya kapalı mı?” diye sordu Ostrane.| Liste vb.| Labels.csv açılır.| Bkz. şek. 9 ve böl. 2.",
    "« Est-ce fermé ? » demande Zeptin.| M. Ostrane pense.| Est-ce vrai ... ou pas ?!| Cf. p. ex. no. 9, fig. 7 etc.| À la fin.",
    "Najpierw zbiór… potem pierścień.| „Graf ogranicza. Nic się nie ruszyło” – mówi Zeptin.| Wg prof. J. K. Ostrane i in. tj. autora itd.| P. Tarquil mówi.",
    "Part 8: the sample\n\n| The log\nchanges at night.\n| It splits.\n\n\n| Rest",
]


@pytest.mark.parametrize("case", CASES)
def test_sentences(case):
    want, text, at = [], "", 0
    for part in case.split("|"):
        body = part.strip()
        if body:
            s = at + part.index(body)
            want.append((s, s + len(body)))
        text += part
        at += len(part)
    got = S.split(text)
    assert [text[a:b] for a, b in got] == [text[a:b] for a, b in want]
    assert got == want


def test_sentence_edges(spark):
    assert S.split(None) == S.split("") == S.split(" \n\t　") == []
    assert [(a, b) for a, b in S.split("समूह है| लेखा है|")] == [(0, 8), (9, 17)]
    assert S.split("𝒳 ends. 😀 Next.")[0] == (0, 7)
    for nasty in ("a" * 1_000_000, "“" * 20_000, "." * 200_000, "(" * 5000 + ". A", '"' * 20_001, "a. " * 100_000, "ก " * 100_000, "«a. " * 20_000):
        units = S.split(nasty)
        assert "".join(nasty[a:b] for a, b in units).replace(" ", "") == nasty.replace(" ", "")
        assert all(x[1] <= y[0] for x, y in zip(units, units[1:]))
    df = spark.createDataFrame([(1, "A. B c. D", 9), (1, "A. B c. D", 9), (None, "One. Two.", 9), (2, None, 9), (3, "", 9), (4, " ", 9)], "doc_id bigint, text string, start_pos int")
    got = sorted(map(tuple, S.sentence_units(df).collect()), key=str)
    assert len(got) == 2 * len(S.split("A. B c. D")) + 2
    assert S.sentence_units(df.where("doc_id > 9")).count() == 0


@pytest.mark.parametrize("sentences", [5, 30, 3000])
def test_long_quotations_are_protected(sentences):
    inside = "The cat is here. " * sentences
    for a, b in ("“”", "«»", '""', "()"):
        text = f"Umbrathe says {a}{inside.strip()}{b} for now. Next one."
        assert [text[s:e] for s, e in S.split(text)] == [text[: -len(" Next one.")], "Next one."]
    cut_off = f"Umbrathe wrote: “{inside.strip()}"
    assert S.split(cut_off) == [(0, len(cut_off))]


def test_contexts_have_no_bound():
    for blanks in (1, 70, 5000):
        text = "The end." + " " * blanks + "Next one."
        assert S.split(text) == [(0, 8), (8 + blanks, len(text))]
    assert len(S.split("One two" + " three" * 500 + ". Next one.")) == 2
    assert len(S.split("समूह है। " + "1234 5678 " * 100 + "। लेखा है।")) == 3


def test_abbreviations_of_the_language():
    assert len(S.split("The list of the edges is in the file, Fig. 3 shows that.")) == 1
    assert len(S.split("La arista está en la red por el umbral, fig. 3 no es del anillo.")) == 1
    turkish = "Listede tohumlar, yollar vs. 3. adımda dosya eşiği bölüyor."
    assert len(S.split(turkish)) == 2
    assert len(S.split(turkish.replace("Listede tohumlar, yollar", "The log and the file"))) == 1


@pytest.mark.parametrize("piece", ["“", "(a ", "a.", "Dr. ", '"a. ', "กา (ก ", "x1.", "环形。", "(है|) "])
def test_time_grows_with_length(piece):
    import time

    took = []
    for n in (4_000, 40_000):
        t = time.process_time()
        S.split(piece * n)
        took.append(time.process_time() - t)
    assert took[1] < 30 * max(took[0], 0.05)
