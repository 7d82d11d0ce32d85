"""The pipeline's language stage on planted documents: it keeps learned languages and rejects by the model."""

import random

import corpus_pipeline
from gridloom.llm import langid

WORDS = {
    "en": "the people of this small town were always ready to help each other when winter came and nobody had enough bread for their children".split(),
    "de": "die menschen dieser kleinen stadt waren immer bereit einander zu helfen wenn der winter kam und niemand genug brot für seine kinder hatte".split(),
    "fr": "les gens de cette petite ville étaient toujours prêts à aider leurs voisins quand venait le hiver et que personne ne avait assez de pain".split(),
    "es": "la gente de este pueblo pequeño siempre estaba dispuesta a ayudar cuando llegaba el invierno y nadie tenía bastante pan para sus niños".split(),
}
FINNISH = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."
RUSSIAN = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью."
TURKISH = "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler."


def test_stage_rejects_foreign_text_and_gibberish(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    noise = lambda n: " ".join("".join(rng.choices(letters, k=rng.randrange(3, 10))) for _ in range(n))
    rows = [(1000 * k + i, " ".join(rng.choices(w, k=rng.randrange(3, 90))), lang) for k, (lang, w) in enumerate(WORDS.items()) for i in range(40)]
    keep = {r[0] for r in rows}
    bad = [FINNISH, RUSSIAN, TURKISH, noise(12), noise(80), noise(500), "123 456", "", None]
    rows += [(9000 + i, t, ("en", "de", None)[i % 3]) for i, t in enumerate(bad)]
    few = [(9900, "town", "en"), (9901, "xqz", None)]  # too few letters to tell
    docs = spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows + few], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.identify(spark, docs, "").collect()}
    assert got == keep | {9900, 9901}


def test_letter_runs_are_those_of_the_jvm(spark):
    from pyspark.sql import functions as F

    texts = ["a²b ⅷx ⅣⅥ y", "über straße１２ x", "中文字٣ب", "no others", "½ⓐ㊀z", "état", "ª º"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.regexp_extract_all("t", F.lit(r"\p{L}{1,24}"), F.lit(0)).alias("w")).collect()
    assert {r["i"]: r["w"] for r in got} == {i: langid.letter_runs(t) for i, t in enumerate(texts)}
