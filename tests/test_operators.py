import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.functions import text as T
from corpusloom.operators import alignment as A
from corpusloom.operators import batching as B
from corpusloom.operators import mining as M
from corpusloom.operators import rewrite as R
from corpusloom.operators import series as S
from corpusloom.operators import takes as K
from corpusloom.streaming import metric_log as L

GOOD = dict(id="A", take="1", cat="D", seconds=3.0, peak=0.5, clipped=0.0, syllables=10, cer=0.0, similarity=0.8, buzz=10.0, ring=0.1, range_st=15.0, end_drop_st=6.0)
GATES = dict(min_similarity=0.6, min_buzz=8.0, max_ring=0.25, min_range_st=8.0, exclamation_range_st=14.0)


@pytest.mark.parametrize(
    ("change", "reason"),
    [({}, None), ({"seconds": 0.5}, "short"), ({"seconds": 15.0, "syllables": 60}, "long"), ({"peak": 0.01}, "silent"), ({"clipped": 0.01}, "clipped"), ({"syllables": 40}, "pace"), ({"cer": 0.03}, "misread"), ({"similarity": 0.5}, "voice"), ({"buzz": 7.0}, "buzz"), ({"ring": 0.3}, "ring"), ({"range_st": 5.0}, "monotone"), ({"range_st": math.nan}, "monotone"), ({"ring": math.nan}, None), ({"cat": "C", "range_st": 10.0}, "flat_exclamation"), ({"cat": "I", "cer": 0.5}, None), ({"cat": "G1", "seconds": 20.0, "syllables": 80}, None)],
)
def test_gate_chain(spark, change, reason):
    row = spark.createDataFrame([GOOD | change])
    gates = spark.createDataFrame([GATES])
    assert K.judged(row, gates, K.GateRules()).first().reason == reason


def test_choice_prefers_few_errors_then_fall_then_sound(spark):
    rows = [GOOD | {"take": "1", "cer": 0.01}, GOOD | {"take": "2"}, GOOD | {"take": "3", "buzz": 11.0}, GOOD | {"id": "B", "ring": 0.9}]
    out = {r.id: r for r in K.choose(K.judged(spark.createDataFrame(rows), spark.createDataFrame([GATES]), K.GateRules()), K.GateRules()).collect()}
    assert out["A"].take == "3" and out["B"].take is None and out["B"].dropped == {"1": "ring"}
    rising = [GOOD | {"cat": "A1", "take": "1", "end_drop_st": math.nan}, GOOD | {"cat": "A1", "take": "2", "end_drop_st": 3.0}]
    assert K.choose(K.judged(spark.createDataFrame(rising), spark.createDataFrame([GATES]), K.GateRules()), K.GateRules()).first().take == "2"


words = st.lists(st.sampled_from("abc"), max_size=9)


@settings(max_examples=150, deadline=None)
@given(words, words, words)
def test_distance_is_a_metric(a, b, c):
    assert A.distance(a, b) == A.distance(b, a) and (A.distance(a, b) == 0) == (a == b)
    assert A.distance(a, c) <= A.distance(a, b) + A.distance(b, c)
    ops = A.alignment(a, b)
    assert sum(o["op"] != "ok" for o in ops) == A.distance(a, b)
    assert [o["ref"] for o in ops if o["ref"] is not None] == a and [o["hyp"] for o in ops if o["hyp"] is not None] == b


def test_alignment_prefers_deletion_to_insertion():
    assert [o["op"] for o in A.alignment(list("ab"), list("ba"))] == ["sub", "sub"]
    assert [(o["op"], o["ref"]) for o in A.alignment(list("aab"), list("ab"))] == [("del", "a"), ("ok", "a"), ("ok", "b")]


def test_long_alignment_keeps_few_rows():
    a = [str(i % 7) for i in range(2000)]
    assert [o["op"] for o in A.alignment(a, a[:700] + a[701:])].count("ok") == 1999


def test_text_rules(spark):
    row = spark.createDataFrame([("IŞIQ İki",), ("  two   words ",), (None,), ("",)], "t string")
    assert [r[0] for r in row.select(T.az_lower("t")).collect()] == ["ışıq iki", "  two   words ", None, ""]
    assert [r[0] for r in row.select(T.squeezed("t")).collect()] == ["IŞIQ İki", "two words", None, ""]
    assert row.select(T.syllables("t").alias("n")).first().n == 4


REWRITES = [
    ("25% artım", "iyirmi beş faiz artım"), ("%25 artım", "iyirmi beş faiz artım"), ("25%-i", "iyirmi beş faizi"), ("1,5 metr", "bir tam onda beş metr"), ("2,75", "iki tam yüzdə yetmiş beş"), ("-3 dərəcə", "mənfi üç dərəcə"),
    ("10-15 nəfər", "on ilə on beş nəfər"), ("1941-1945-ci illər", "min doqquz yüz qırx bir ilə min doqquz yüz qırx beşinci illər"), ("5-ci sıra", "beşinci sıra"), ("10-da qaldı", "onda qaldı"), ("2024-cü ildə", "iki min iyirmi dördüncü ildə"),
    ("19,99 AZN", "on doqquz manat doxsan doqquz qəpik"), ("0,50 azn", "əlli qəpik"), ("5,00 AZN", "beş manat"), ("10 AZN-dən", "on manatdan"), ("$25", "iyirmi beş dollar"), ("5 mln AZN", "beş milyon manat"), ("AZN ilə", "manat ilə"), ("7 rub", "yeddi rubl"),
    ("salam dünya.", "salam dünya."), ("1.000.000 nəfər", "bir milyon nəfər"), ("2024 100", "iki min iyirmi dörd yüz"), ("11000", "on min"), ("007", "sıfır sıfır yeddi"), ("COVID-19", "kovid on doqquz"), ("+5", "üstəgəl beş"),
    ("3/4", "dörddə üç"), ("24/7", "iyirmi dörd bölü yeddi"), ("2/3-si", "üçdə ikisi"), ("14:05", "on dörd sıfır beş"), ("00:00", "sıfır sıfır"), ("saat 09:00", "saat doqquz"), ("14:30-da", "on dörd otuzda"), ("09:00-da", "doqquzda"), ("25:10", "iyirmi beş on"),
    ("15.03.2024", "on beş mart iki min iyirmi dördüncü il"), ("15.03.2024-cü ildə", "on beş mart iki min iyirmi dördüncü ildə"), ("15.03.2024 ildə", "on beş mart iki min iyirmi dördüncü ildə"), ("01/12/1999", "bir dekabr min doqquz yüz doxsan doqquzuncu il"),
    ("2024-03-15", "on beş mart iki min iyirmi dördüncü il"), ("15/08", "on beş avqust"), ("01 may", "bir may"), ("1.2.3", "bir nöqtə iki nöqtə üç"),
    ("+994 50 123 45 67", "doqquz yüz doxsan dörd əlli yüz iyirmi üç qırx beş altmış yeddi"), ("+994501234567", "doqquz yüz doxsan dörd əlli yüz iyirmi üç qırx beş altmış yeddi"), ("050 123 45 67", "sıfır əlli yüz iyirmi üç qırx beş altmış yeddi"), ("0501234567", "sıfır əlli yüz iyirmi üç qırx beş altmış yeddi"), ("(050) 123-45-67", "sıfır əlli yüz iyirmi üç qırx beş altmış yeddi"),
    ("II Dünya müharibəsi", "İkinci Dünya müharibəsi"), ("fəsil XI", "fəsil on birinci"), ("bu XX əsrdə", "bu iyirminci əsrdə"), ("Bitdi. XX əsr", "Bitdi. İyirminci əsr"), ("XX-ci əsr", "İyirminci əsr"), ("V əsr", "Beşinci əsr"), ("bu V və X", "bu V və X"), ("XIX-XX əsr", "On doqquzuncu ilə iyirminci əsr"), ("CD DVD", "ce de de ve de"),
    ("5 kq", "beş kiloqram"), ("16 GB", "on altı giqabayt"), ("5 KM", "beş kilometr"), ("5 ha", "beş hektar"), ("3 km-ə", "üç kilometrə"), ("5 mərtəbə", "beş mərtəbə"), ("80 km/saat", "səksən kilometr saatda"),
    ("alma, armud və s.", "alma, armud və sairə"), ("məs. belə", "məsələn belə"), ("Prof. Əli", "professor Əli"), ("e.ə. 5", "eramızdan əvvəl beş"),
    ("ATM kartı", "a te em kartı"), ("ATM-də", "a te emdə"), ("AMEA-nın", "a em e anın"), ("DİQQƏTLİ ol", "DİQQƏTLİ ol"), ("Google-da", "Quglda"), ("bu google-dan", "bu qugldan"), ("iPhone 15", "Ayfon on beş"),
    ("№ 5", "nömrə beş"), ("Ali & Vəli", "Ali və Vəli"), ("“Salam…”", '"Salam."'), ("2x3", "iki vurulsun üç"), ("3:2", "üç iki"), ("  Salam   , dünya  ", "Salam, dünya"), ("", ""),
]


def test_spoken_form_and_its_idempotence(spark):
    docs = spark.createDataFrame(list(enumerate(t for t, _ in REWRITES)), "doc_id long, text string")
    once = R.spoken_form(docs)
    assert {r.doc_id: r.text for r in once.collect()} == dict(enumerate(w for _, w in REWRITES))


@pytest.mark.parametrize(("n", "said"), [(0, "sıfır"), (7, "yeddi"), (105, "yüz beş"), (1000, "min"), (1001, "min bir"), (11000, "on min"), (1_001_000, "bir milyon min"), (121_001, "yüz iyirmi min bir"), (2_000_000, "iki milyon")])
def test_number_words(spark, n, said):
    assert spark.range(1).select(R.number_words(F.lit(n).cast("long"))).first()[0] == said


GROUPS = [("1 234 567 890", "1234567890"), ("12 345 678 901 234 x", "12345678901234 x"), ("1.234.567.890.", "1234567890."), ("1,000,000 və 2,000", "1000000 və 2,000"), ("1.234.5", "1.234.5"), ("1 234 5678", "1234 5678"), ("0.001 2020 100", "0.001 2020 100"), ("1\xa0234\xa0567", "1234567"), ("1 234, 5 678 910", "1234, 5678910")]


def test_thousands_join_whole_runs(spark):
    rows = spark.createDataFrame([(a,) for a, _ in GROUPS], "t string")
    assert [r[0] for r in rows.select(R.thousands("t")).collect()] == [b for _, b in GROUPS]


def test_long_numbers_are_spoken(spark):
    ones = "bir iki üç dörd beş altı yeddi səkkiz doqquz sıfır"
    said = [("1000000000000000", "bir kvadrilyon"), ("12345678901234567890", f"{ones} {ones}"), ("0" * 5 + "12", " ".join(["sıfır"] * 5) + " on iki"), ("x 12345678901234567890-ci", f"x {ones} {ones[:-5]}sıfırıncı"), ("1,12345678901", "bir tam bir iki üç dörd beş altı yeddi səkkiz doqquz sıfır bir"), ("12345678901234567890 kq", f"{ones} {ones} kiloqram"), ("1 000 000 000 000", "bir trilyon")]
    docs = spark.createDataFrame(list(enumerate(t for t, _ in said)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in R.spoken_form(docs).collect()} == dict(enumerate(w for _, w in said))


def test_operators_run_over_documents_with_colons(spark, tmp_path):
    said = [("3:2", "3 2"), ("100:99 və 1:2:3", "100 99 və 1 2 3"), ("a: 2x3", "a: 2 vurulsun 3"), ("4 x 5", "4 vurulsun 5")]
    spark.createDataFrame([(i, t, "s", "az") for i, (t, _) in enumerate(said)], "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in catalog.queries()["tx9_operators"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(w for _, w in said))


def test_clauses_of_long_documents_stay_apart(spark, tmp_path):
    texts = {1: "one two three\n" * 1002, 2: "four five six\nseven eight nine"}
    spark.createDataFrame([(i, t, "s", "en") for i, t in texts.items()], "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.version, r.place): r.n for r in catalog.queries()["ea9_position_errors"](spark, str(tmp_path)).collect()}
    assert got == {(v, p): 1004 for v in ("step", "base") for p in ("first", "middle", "last")}


def chunks_of(spark, text, most, **more):
    rows = R.chunk_rows(spark.createDataFrame([(0, text)], "doc_id long, text string"), most, **more).orderBy("s", "k").collect()
    return [r.chunk for r in rows]


def test_chunks_keep_every_word(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alma", "və", "armud,", "gəl.", "ki"]) for _ in range(rng.randint(0, 90))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = R.chunk_rows(docs, 10).orderBy("doc_id", "s", "k").collect()
    for i, t in enumerate(texts):
        chunks = [r.chunk for r in rows if r.doc_id == i]
        assert " ".join(chunks).split() == t.split() and all(len(c.split()) <= 10 for c in chunks)


def test_chunks_are_cut_where_a_reader_pauses(spark):
    ten, other = " ".join(["söz"] * 10), " ".join(["kəlmə"] * 10)
    assert chunks_of(spark, f"{ten}, {other}", 15) == [f"{ten},", other]
    assert chunks_of(spark, f"{ten} və {other}", 15) == [ten, f"və {other}"]
    assert chunks_of(spark, " ".join(["söz"] * 40), 10) == [ten] * 4
    assert chunks_of(spark, "a, b, c d e, f g h i", 5) == ["a,", "b,", "c d e,", "f g h i"]  # clauses are not joined again
    assert chunks_of(spark, "Salam\n\n  dünya. Necəsən?", 25) == ["Salam dünya.", "Necəsən?"]


def test_pieces_keep_to_the_limit(spark):
    docs = spark.createDataFrame([(0, "aa bb, cc dd; ee ff gg hh. ii"), (1, "x" * 23 + " yy"), (2, ""), (3, None)], "doc_id long, text string")
    rows = R.limited_rows(docs, 10).orderBy("doc_id", "s", "k").collect()
    assert [(r.doc_id, r.piece) for r in rows] == [(0, "aa bb,"), (0, "cc dd;"), (0, "ee ff gg"), (0, "hh."), (0, "ii"), (1, "x" * 10), (1, "x" * 10), (1, "xxx yy")]
    assert all(len(r.piece) <= 10 for r in rows) and " ".join(r.piece for r in rows if r.doc_id == 0) == "aa bb, cc dd; ee ff gg hh. ii" and {r.doc_id for r in rows} == {0, 1}


def test_numbers_run_within_categories(spark):
    rows = spark.range(500).select(F.when(F.col("id") < 400, "a").when(F.col("id") < 490, "b").alias("cat"), F.lit("s").alias("src"), F.pmod(F.col("id") * 7, F.lit(500)).alias("id"), F.lit(1).alias("seq"))
    by = {}
    for r in M.numbered(rows).orderBy("id").collect():
        by.setdefault(r.cat, []).append(r.number)
    assert by == {"a": list(range(1, 401)), "b": list(range(1, 91)), None: list(range(1, 11))}


def test_marks_ahead(spark):
    rows = spark.createDataFrame([(1, i, m) for i, m in enumerate([None, ".", None, "?", None])], "d long, i int, m string")
    assert [r.ends_with for r in S.look_ahead(rows, "i", "m", ["d"]).orderBy("i").collect()] == [".", ".", "?", "?", None]


def test_redaction_merges_markers(spark):
    docs = spark.createDataFrame([(1, "foooo bar foobar foot end")], "doc_id long, text string")
    flags = R.flagged_words(docs, spark.createDataFrame([("foo",)], "stem string"), spark.createDataFrame([("foot",)], "stem string"))
    assert [r.bad for r in flags.orderBy("at").collect()] == [False, False, True, False, False]


def test_batches_hold_both_limits_and_are_stable(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(i, rng.randint(94, 1360)) for i in range(5000)], "id long, frames int")
    make = lambda: sorted(map(tuple, B.frame_budget_batches(rows, "frames", 64, 64 * 1360, 1).select("id", "pool", "batch", "frames").collect()))
    got = make()
    assert got == make() and [g[0] for g in got] == list(range(5000))
    by = {}
    for _, p, b, f in got:
        by.setdefault((p, b), []).append(f)
    assert all(len(v) <= 64 and len(v) * max(v) <= 64 * 1360 for v in by.values())
    assert sum(len(v) * max(v) - sum(v) for v in by.values()) / sum(map(sum, by.values())) < 0.05
    with pytest.raises(Exception, match="budget"):
        B.frame_budget_batches(rows, "frames", 64, 1000).collect()


def test_numbering_over_all_rows(spark):
    rows = spark.range(1000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(50)))
    got = [r.number for r in M.numbered_overall(rows, ["k", "id"]).orderBy("k", "id").collect()]
    assert got == list(range(1, 1001))


def test_grid_interpolates_between_voiced_neighbours(spark):
    track = spark.createDataFrame([("s", float(t), hz) for t, hz in enumerate([100.0, 400.0, 0.0, 0.0, 200.0, 200.0])], "s string, t double, hz double")
    grid = spark.createDataFrame([("s", t + 0.75) for t in range(5)] + [("s", 9.0)], "s string, t double")
    got = [r.hz for r in S.onto_grid(track, grid, 1.0, ["s"]).orderBy("t").collect()]
    assert got == pytest.approx([100 * 4**0.75, 0.0, 0.0, 200.0, 200.0, 0.0])


def test_stream_skips_broken_lines_and_reads_new_files_once(spark, tmp_path):
    logs, out, seen = (str(tmp_path / x) for x in ("logs", "out", "seen"))
    (tmp_path / "logs").mkdir()
    line = '{"run":"a","attempt":0,"step":%d,"stage":"x","epoch":0,"wall_time":%d.5,"loss":1.0}\n'
    (tmp_path / "logs/1.txt").write_text(line % (1, 1) + "garbage\n" + line % (2, 3) + '{"run":"a","st')
    L.follow(L.read_log(spark, logs), out, seen).awaitTermination()
    (tmp_path / "logs/2.txt").write_text(line % (3, 5))
    L.follow(L.read_log(spark, logs), out, seen).awaitTermination()
    rows = spark.read.schema(L.METRIC).parquet(out)
    assert sorted(r.step for r in rows.collect()) == [1, 2, 3]
    now = L.status(rows, 10, 1.0).first()
    assert (now.step, now.percent, now.seconds_per_step, now.eta_seconds) == (3, 30.0, 2.0, 14.0)


def test_first_wins_and_merge_reasons(spark):
    rows = spark.createDataFrame([("b", 1, 1, "x.", "x"), ("a", 2, 1, "X.", "x"), ("a", 1, 1, "bad", "x"), ("a", 3, 1, "known.", "known"), ("a", 4, 1, "", "")], "src string, id long, seq long, text string, k string")
    assert M.first_of_key(rows.where("k = 'x'")).first().id == 1
    out = {(r.src, r.id): r.reason for r in M.merged(rows, ~F.col("text").endswith("."), spark.createDataFrame([("known",)], "k string")).collect()}
    assert out == {("b", 1): "duplicate", ("a", 2): None, ("a", 1): "checker", ("a", 3): "known", ("a", 4): "bad row"}


def test_latest_run_orders_numbers_as_numbers(spark):
    from corpusloom.streaming.metric_log import latest_run

    rows = spark.createDataFrame([("r9", 1), ("r10", 2), ("r10", 3), ("r2", 4)], "run string, step long")
    assert sorted((r.run, r.step) for r in latest_run(rows).collect()) == [("r10", 2), ("r10", 3)]
    assert latest_run(rows.where("run <> 'r10'")).first().run == "r9" and latest_run(rows.limit(0)).count() == 0
