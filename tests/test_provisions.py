"""References to provisions: rendered from known paths, and by hand."""

import random

from pyspark.sql import functions as F

from verdigris.functions.legal import provision_references

ROMAN = ["I", "II", "III", "IV", "IX", "XL", "C"]


def rendered(rng):
    """A text and the paths that it names."""
    held, last, paths, text = {}, -1, [], []
    for _ in range(rng.randint(1, 8)):
        level = rng.randint(0, 3) if last >= 0 else rng.choice([0, 0, 1])
        if level <= last:
            paths.append(dict(held))
        number = str(rng.randint(1, 40))
        if level == 0:
            tail = rng.choice(["", "", "-A"])
            held = {0: number + tail.lower()}
            text.append(rng.choice([f"art. {number}º{tail}", f"Artigo {number}{tail}", f"no art {number}{tail}"]))
        elif level == 1:
            value = rng.choice([number, "único"])
            held = {k: v for k, v in held.items() if k < 1} | {1: value.replace("ú", "u")}
            text.append("parágrafo único" if value == "único" else rng.choice([f"§ {number}º", f"§{number}", f"parágrafo {number}º"]))
        elif level == 2:
            value = rng.choice(ROMAN)
            held = {k: v for k, v in held.items() if k < 2} | {2: value.lower()}
            text.append(rng.choice([f"inciso {value}", f"incisos {value}"]))
        else:
            value = rng.choice("abcxyz")
            held = {k: v for k, v in held.items() if k < 3} | {3: value}
            text.append(rng.choice([f"alínea {value}", f'alínea "{value}"', f"alíneas '{value}'"]))
        last = level
    paths.append(held)
    names = ["art. ", "§ ", "inciso ", "alínea "]
    shown = [", ".join(names[k] + p[k] for k in sorted(p)) for p in paths]
    return rng.choice([", ", " e ", "; ", " da norma, "]).join(text), list(dict.fromkeys(shown))


def test_rendered_references(spark):
    rng = random.Random(40)
    cases = [rendered(rng) for _ in range(300)]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    for r in frame.select("i", provision_references(F.col("t")).alias("p")).collect():
        assert r.p == cases[r.i][1], cases[r.i]


def test_by_hand(spark):
    cases = [
        (None, []), ("", []), ("sem referência a nada, e a arte 5", []), ("o art. 5º, II, da lei", ["art. 5, inciso ii"]),
        ("conforme o art. 3º, § 1º, inciso IV, alínea b) e o art. 7º", ["art. 3, § 1, inciso iv, alínea b", "art. 7"]),
        ("arts. 8 e 9", ["art. 8"]), ("art. 5, § 1º e § 2º; art. 5, § 1º", ["art. 5, § 1", "art. 5, § 2"]), ("x " * 20_000 + "art. 1", ["art. 1"]),
    ]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert {r.i: r.p for r in frame.select("i", provision_references(F.col("t")).alias("p")).collect()} == {i: p for i, (_, p) in enumerate(cases)}
