import pytest

from strandline.llm import subjects as sb

DOCS = "doc_id bigint, text string, subject string, share int"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(s,) for s in ("software", "science", "law", "sport", "finance", "medicine", "cooking", "music", None)], "subject string")


CASES = [
    (1, "The compiler and the linker were compared. The search returned 5 hits.", {"software"}),
    (2, "THE ORCCHESTRA PLAYED.\nThe court heard the plaintiff.", {"music", "law"}),
    (3, "Somebody asked about the bar. The chord and the melody depend on the choir.", {"music"}),
    (4, "第3天又开始发烧。疫苗剂量。", {"medicine"}),
    (5, "La note sur partition cite aussi gamme.", {"music"}),
    (6, "Die Notiz zu Bilanz nennt auch Dividende.", {"finance"}),
    (7, "The agent opened src/x.ts and read 4 lines. Session 5 was resumed.", set()),
    (8, None, set()), (9, "", set()), (10, "  \n", set()),
    (11, "Barley and keyboards, scored. Unnoted.", set()),
    (12, " ".join(["Garlic in the oven."] * 3 + ["The verdict stands."]), {"cooking", "law"}),
    (13, " ".join(["Garlic in the oven."] * 4 + ["The verdict stands."]), {"cooking"}),
    (14, "The enzyme is new. " * 40_000, {"science"}),
    (14, "The enzyme is new.", {"science"}),
    (None, "The marinade.", {"cooking"}),
]


def test_assignment(spark, table):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t, _ in CASES], DOCS)
    got = {}
    for r in sb.assign_subjects(df, table).collect():
        got.setdefault(r.doc_id, []).append(r.subject)
    expected = {}
    for i, _, s in CASES:
        expected.setdefault(i, []).extend(s)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items() if v}
    assert sb.assign_subjects(df.limit(0), table).count() == 0
    assert sb.assign_subjects(df, table.where("subject = 'law'")).select("subject").distinct().count() == 1


def test_hand_labels_agree(spark, data):
    """The labels, a part of which is wrong, agree with thresholds that nothing was fitted to."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "doc_labels"))
    truth = {tuple(r) for r in labels.where("subject is not null").select("doc_id", "subject").distinct().collect()}
    of = {d for d, _ in truth}
    subjects = spark.read.parquet("/root/testdata/sf0.01/subjects.parquet")
    found = {tuple(r) for r in sb.assign_subjects(docs, subjects).collect() if r.doc_id in of}
    hit = len(found & truth)
    assert 2 * hit / (len(found) + len(truth)) > 0.85


def test_calibration_follows_labels_beyond_their_noise(spark):
    shares = spark.createDataFrame([(i, s, (i % 40) / 40) for i in range(2000) for s in ("high", "as stated", "noisy")], "doc_id bigint, subject string, share double")
    rows = [(i, "high") for i in range(2000) if i % 40 >= 20] + [(i, "as stated") for i in range(2000) if i % 40 >= 10] + [(i, "noisy") for i in range(2000) if (i % 40 >= 10) != (i % 97 == 0)]
    labels = spark.createDataFrame([*rows, (None, "high"), (3, None), *rows[:5]], "doc_id bigint, subject string")
    assert sb.calibrate(shares, labels) == {"high": 0.5}
    assert sb.calibrate(shares, labels.limit(0)) == {} and sb.calibrate(shares.limit(0), labels.limit(0)) == {}


def test_calibration_counts_every_label(spark):
    """Ten of 200 000 labelled documents speak for a threshold, the least that can; a part of the labels would miss some."""
    shares = spark.range(200_000).selectExpr("id as doc_id", "'law' as subject", "if(id % 20000 = 7, 0.3d, 0.9d) as share")
    labels = spark.range(200_000).selectExpr("id as doc_id", "if(id % 20000 = 7, 'sport', 'law') as subject")
    assert sb.calibrate(shares, labels) == {"law": 0.325}
    assert sb.calibrate(shares.where("doc_id <> 7"), labels) == {}


HELD_OUT = [  # sentences written by hand, after the terms, none from the tables
    ("The surgeon removed the patient's appendix before the infection could spread.", "medicine"), ("Her asthma got worse and the doctor changed the prescription.", "medicine"),
    ("Nach der Operation musste der Patient noch eine Woche im Krankenhaus bleiben.", "medicine"), ("Le médecin a prescrit un antibiotique contre la fièvre.", "medicine"), ("医生给病人开了抗生素。", "medicine"),
    ("The jury found the defendant guilty on all counts.", "law"), ("Das Gericht wies die Klage ab.", "law"), ("L'avocat a fait appel du jugement devant le tribunal.", "law"), ("原告向法院提起诉讼。", "law"), ("The lawyers asked the court for an injunction.", "law"),
    ("The striker scored twice and the goalkeeper never had a chance.", "sport"), ("Der Stürmer traf in der Verlängerung per Elfmeter.", "sport"), ("L'arbitre a sifflé la fin du match.", "sport"), ("球队在决赛中点球获胜。", "sport"), ("They lost the championship in the final match of the season.", "sport"),
    ("The central bank raised interest rates to fight inflation.", "finance"), ("Die Aktie verlor an der Börse zehn Prozent.", "finance"), ("La banque a augmenté son taux d'intérêt.", "finance"), ("央行上调了利率以抑制通胀。", "finance"), ("Shareholders approved the dividend.", "finance"),
    ("Simmer the broth with garlic and add the noodles at the end.", "cooking"), ("Den Teig kneten und im Backofen backen.", "cooking"), ("Faites fondre le beurre puis ajoutez la farine.", "cooking"), ("把大蒜和洋葱放进锅里炒香。", "cooking"), ("Preheat the oven before baking the bread.", "cooking"),
    ("The pianist played a sonata and the orchestra joined in.", "music"), ("Der Chor probte die Melodie mit dem Dirigenten.", "music"), ("Le violon et le piano jouent la même mélodie.", "music"), ("乐团在音乐会上演奏了交响乐。", "music"), ("The singer forgot the second verse of the song.", "music"),
    ("Telescopes observed a distant galaxy and its black hole.", "science"), ("Das Experiment zeigte, wie die Teilchen zerfallen.", "science"), ("Les chercheurs ont séquencé le génome de la bactérie.", "science"), ("科学家用望远镜观测行星的轨道。", "science"), ("The chemist mixed the catalyst with a solvent.", "science"),
    ("The garbage collector freed the heap but the memory leak remained.", "software"), ("Der Entwickler fand den Fehler im Quellcode.", "software"), ("Le développeur a corrigé le bogue dans le code source.", "software"), ("程序员修复了代码中的内存泄漏。", "software"), ("We deployed the microservice after the pull request was merged.", "software"),
]


def test_terms_carry_to_other_text(spark, table):
    """Precision and recall on sentences that the terms weren't written from."""
    df = spark.createDataFrame([(i, t, "clash", 1) for i, (t, _) in enumerate(HELD_OUT)], DOCS)
    found = {(r.doc_id, r.subject) for r in sb.assign_subjects(df, table).collect()}
    truth = {(i, s) for i, (_, s) in enumerate(HELD_OUT)}
    assert len(found & truth) / len(truth) >= 0.9 and len(found & truth) / len(found) >= 0.9


def test_languages():
    assert sb.language_of("die note und der akkord") == "de" and sb.language_of("la note sur le piano") == "fr" and sb.language_of("note") is None
