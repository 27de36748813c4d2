import random

from graphloom.llm import scan_repair as sr
from test_scan_repair import WORDS, prose


def folder(spark, path, blocks, sentences=()):
    spark.createDataFrame([(f"b{k}", "digital", x) for k, x in blocks], "block_id string, layer string, text string").write.parquet(f"{path}/structured_blocks.parquet")
    spark.createDataFrame([(f"s{k}", "digital", x) for k, x in sentences], "id string, layer string, text string").write.parquet(f"{path}/sentences.parquet")
    for name in ("canonical_entities", "seed_entities"):
        spark.createDataFrame([("Stainless steel", None)], "preferred_name string, aliases_json string").write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_every_row_counts(spark, tmp_path):
    """9,000 short rows; each of 150 holds an ideograph between two that stand nowhere else."""
    left, middle, right = (lambda k, base=base: chr(base + k) for base in (0x4E00, 0x5E00, 0x6E00))
    rows = [f"{left(k)}{middle(k)}{right(k)}" for k in range(150)] + [prose(random.Random(k), 4) for k in range(8850)]
    editor = sr.fit_editor(spark, folder(spark, tmp_path, enumerate(rows)))
    assert [editor.sign(left(k), right(k)) for k in range(150)] == [middle(k) for k in range(150)]


def test_tables_give_the_editor_of_their_texts(spark, tmp_path):
    """3,500 words, some of a letter that only the rarest have, in whatever rows and parts; repeated rows fall together."""
    r = random.Random(6)
    words = ["".join(r.choices("aceilmnorstu", k=r.randint(3, 9))) for _ in range(3400)] + [f"{a}rn{b}ø{b}" for a in "bdgkpvwxyz" for b in "bdfghkpqvw"]
    blocks = [(k, f"{' '.join(words[7 * k : 7 * k + 7])} {r.choice(WORDS)}-{r.choice(WORDS)} 硬度{'升降高低'[k % 4]}") for k in range(500)]
    sentences = [(k, prose(r, 6)) for k in range(60)] + [(900, None), (901, "")]
    made = sr.fit_editor(spark, folder(spark, tmp_path, blocks + blocks[:40], sentences + sentences[:9]))
    texts = [x for _, x in blocks + sentences if x]
    plain = sr.train(texts, sr.Known.of([*texts, "Stainless steel"]))
    assert made.known.raw == plain.known.raw and made.follows == plain.follows and made.model.weights == plain.model.weights
    again = sr.fit_texts(spark.createDataFrame([(x,) for x in reversed(texts)], "text string").repartition(7), plain.known)
    assert again.model.weights == plain.model.weights and again.follows == plain.follows
    assert any("ø" in f for f in plain.model.weights)


def test_neighbours_of_a_long_row_all_count():
    text = prose(random.Random(2), 300)
    words = sr._WORD.findall(text)
    assert len(words) >= 300 and sum(n for (kind, _, _), n in sr.clean_forms([text]).items() if kind == "g") == len(words) - 1


def test_counts_stand_for_their_examples():
    counts = [(("a",), "K", 0.25), (("b",), "E", 3.5), (("c",), "K", 1.0)]
    steps = sr._steps(counts)
    assert len(steps) == 6 and all(size <= 1 for _, _, size in steps)
    assert [sum(size for x, _, size in steps if x == y) for y, _, _ in counts] == [0.25, 3.5, 1.0]


def test_no_clean_text(spark, tmp_path):
    editor = sr.fit_editor(spark, folder(spark, tmp_path, []))
    assert editor.follows == {} and sr.defects("the fi1m\nhard-\nness", [], None, editor)[1]
