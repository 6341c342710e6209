"""Fits the trees of ``quality`` and stores them: ``python -m shelfmark.llm.quality_training DOCUMENTS_PARQUET CHECKED_PARQUET``.

Labels are weak: strict rules name documents that are purely one kind and leave
the rest alone. Mixtures of prose and the other kinds, with known shares, teach
where half of a text lies. The sample is bounded by SAMPLE documents, drawn at
random from the whole table. The probabilities are calibrated on one half of
CHECKED, documents of another table that were read and judged by hand; figures
are given for the other half, and for HOLDOUT, texts written for the purpose.
Neither of these two, nor any text equal to one in CHECKED, is trained on.
"""

from __future__ import annotations

import json
import random
import sys

import numpy as np
import pyarrow.parquet as pq

from shelfmark.llm.quality import FIELDS, KINDS, MODEL, Trees, calibrate, fit_kind, letter_pairs, statistics

SAMPLE = 6_000  # documents read at most
# Judged by hand: documents of the table of scale 0.01, whose texts stay there. Those of odd number calibrate, those of even number report.
CHECKED = {
    "prose": [605, 50, 946, 573, 218, 840, 552, 253, 222, 193, 138, 166, 679, 269, 325, 73, 102, 738, 375, 589, 55, 525, 300],
    "list": [817, 44, 784, 566, 742, 611, 171, 517, 865, 21, 93, 411, 27, 586, 185, 231, 695, 767],
    "table": [112, 761, 39, 179, 61, 976, 175, 455, 897, 811, 841, 6, 520, 184, 496, 965, 81, 739, 402, 384],
    "junk": [276, 306, 925, 258, 77, 260, 148, 213, 321, 776, 60, 581, 917, 407, 45, 705, 478, 58, 3, 709, 524],
}
MIXED = 3_000

# Written to be one kind each.
HOLDOUT = [
    ("prose", "The lid was found in the mill.\nIt had been washed and then sold to a dealer in the town.\nNobody knows who made it."),
    ("prose", "Seen from the road the attic hides\na green seal and its base The\nmason who came from the hills\npreferred schist to sandstone"),
    ("prose", "Shop\nVisit\nThe vessel was bought in 1902 and stood in the hall until the war. Two handles are lost.\nPrint this page"),
    ("prose", "Der Krug wurde 1920 im Keller gefunden. Er ist aus Ton und hat einen Griff.\nNiemand weiß, wer ihn gemacht hat."),
    ("prose", "Le vase provient du grenier. Les restes de cire touchaient le socle, et un voisin gardait bien la clef."),
    ("prose", "この古い鏡は骨で作られ、高さは十センチである。\n由来はまだ分からない。"),
    ("prose", "Το κουτί βρέθηκε στο εργαστήριο και δεν είναι γνωστό ποιος το έφτιαξε.\nΜετά το 1950 πήγε στο μουσείο."),
    ("prose", "Старый кувшин лежал около стены. Мастер из города покрыл его слоем золота."),
    ("prose", "The room held four things.\n- a jar\n- a lid\nAll of them were moved to the cellar after the flood, and only one came back in one piece."),
    ("prose", "Was it made for trade, or for use at home? The ledger says 40 jars were sent. The envoy left one behind at the gate of the town."),
    ("list", "1. jar\n2. lid with handle\n3. ring, copper\n4. 12 bead pieces\n5. old comb"),
    ("list", "- marble cup\n- bone pin\n- jar, 1920\n- broken lamp\n- gold ring"),
    ("list", "copper jar\nbone pin\ntwo lids\nlamp with hook\nring, silver\nold comb\nslate palette"),
    ("list", "TOOLS\n   axe\n   bone awl\n   saw, iron\nVESSELS\n   jar\n   cup with lid\n   bowl, 1911"),
    ("list", "copper jar, 12, 40\nbone pin, 77\nlids, 8, 19, 230\nlamp, 61\nring, silver, 14, 15"),
    ("list", "(a) Copper Jar\n(b) Bone Pin\n(c) Lamp With Hook\n(d) Ring, Silver\n(e) Old Comb"),
    ("list", "The finds of the season follow.\n* jar\n* lid with handle\n* ring, copper\n* bone pin\n* old comb\n* lamp with hook\n* saw, iron\n* slate palette"),
    ("table", "| item | cm | year |\n|---|---|---|\n| jar | 12 | 1901 |\n| lid | 4 | 1922 |"),
    ("table", "item,height,year\n\"copper jar\",12,1901\n\"lid\",n/a,1922\n\"ring\",3,-"),
    ("table", "item;cm;place\njar;12;mill\nlid;-;attic\nring;3;hall"),
    ("table", "item\tcm\tplace\njar\t12\tmill\nlid\tn/a\tattic\nring\t3\thall"),
    ("table", "item              cm     place\ncopper jar        12      mill\nlid              n/a     attic\nring               3      hall"),
    ("list", "The store holds these things.\ncopper jar, lamp with hook, bone pin, ring, silver, old comb, 12 lids, saw, iron, slate palette, bowl, 1911, marble cup, gold ring, axe"),
    ("prose", "Shop » Visit » Members » Map\n骨と木の層の下から古い皿が出た。 倉庫には重い印が二点ある。"),
    ("junk", "?|@ *< :>/=+|~^$%-^*#% *.@!.-=|$%$_~>/_!$!/=%?%|; .<*/^$*.# <_~<_;?#_*%"),
    ("junk", "sdfjh asdkjh qwlkej asdlkj hqwe asdjkh qwelkjh asd lkjashd qwe lkjh"),
    ("junk", "6e de d0 4c 95 a5 f9 0d\n58 2a 6c 84 a8 42 4c 8f\n48 31 ac 06 f9 52 cd 07"),
    ("junk", "VJeOsPXyNprdomLGqovYBdXLKrNR6P7n3h0AFizfA6TxGRK3v5oB\n2mtqzeolXFArE4UWOaTbVKpepFBVUl4BotkxbCUShRr2TGZU06n5"),
    ("junk", "<div class=\"ab\">{{x}}</div>\n<li class=\"q\">{{yy}}</li>\n<span>{{z}}</span>"),
    ("junk", "bla bla bla bla bla bla bla bla bla bla bla bla bla bla bla"),
    ("junk", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"),
    ("junk", "xjprÃ©lzxâ€™cybï¿½jmqwnï¿½Å“hukÃ§prâ€œnuÃ¼zz\nÃ©fbÃ§Ã©nwÅ“gr"),
    ("junk", "7#3 mkc3r@m!c!57 53|d0m l@55!gn3d 7#3 sh@x|3 lq@nd\nT#3 st0p3n if|@5k vom3@5ur35"),
    ("junk", "%%%% ---- #### //// %%%% ==== #### ~~~~ $$$$ ----"),
]


def weak_label(s: dict[str, float]) -> str | None:
    """The kind of a document that is purely one, by its statistics; None for the rest."""
    odd_letters = s["bigrams"] < -3.2 and s["common"] < 0.05 and s["wide_script"] < 0.1 and s["letters"] > 0.7 and s["celled"] + s["marked"] + s["aligned"] < 0.3
    if s["markup"] > 0.6 or s["mojibake"] > 0.15 or s["hexes"] > 0.6 or s["long_words"] > 0.5 or s["top_word"] > 0.5 or s["odd_words"] > 0.4 or odd_letters or s["symbols"] > 0.7:
        return "junk"
    if max(s["celled"], s["aligned"]) > 0.85 and s["cells_alike"] > 0.5 and s["sentences"] < 0.1:
        return "table"
    if s["marked"] > 0.85 or s["inline"] > 0.85 or s["bare"] + s["marked"] > 0.9 and s["common"] < 0.08 and s["words_a_line"] < 4.8 and s["bigrams"] > -3.0:
        return "list"
    if s["sentences"] > 0.75 or s["wide_script"] > 0.3 and s["marked"] < 0.3 and s["celled"] < 0.3 or s["common"] > 0.15 and s["marked"] + s["inline"] < 0.15 and s["celled"] + s["aligned"] < 0.15 and s["bare"] < 0.3:
        return "prose"
    return None


def without_title(title: str | None, text: str) -> str:
    return "" if title == text else text[len(title) + 1 :] if title and text.startswith(title + "\n") else text


def checked(path: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(kind, text) of the documents that calibrate and of those that report."""
    kinds = {i: k for k, ids in CHECKED.items() for i in ids}
    rows = [r for r in pq.read_table(path, columns=["doc_id", "title", "text"]).to_pylist() if r["doc_id"] in kinds]
    pairs = [(r["doc_id"], kinds[r["doc_id"]], without_title(r["title"], r["text"])) for r in rows]
    return [(k, t) for i, k, t in pairs if i % 2], [(k, t) for i, k, t in pairs if not i % 2]


def main(path: str, checked_path: str) -> None:
    random.seed(5)
    calibrating, reporting = checked(checked_path)
    known = {t for _, t in calibrating + reporting}
    bodies = pq.read_table(path, columns=["body"]).column(0).to_pylist()
    bodies = [x for x in random.sample(bodies, min(SAMPLE, len(bodies))) if x and x.strip() and x not in known]
    flat = {a + b: -3.0 for a in "^abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz$"}
    flat_scores, scores = {}, {}
    first = [dict(zip(FIELDS, statistics(b, flat, flat_scores))) for b in bodies]
    pairs = letter_pairs(b for b, s in zip(bodies, first) if s["sentences"] > 0.6)
    rows = [statistics(b, pairs, scores) for b in bodies]
    labels = [weak_label(dict(zip(FIELDS, r))) for r in rows]
    pure = {k: [b for b, x in zip(bodies, labels) if x == k] for k in KINDS}
    print({k: len(v) for k, v in pure.items()}, "left alone:", labels.count(None))
    x, y = [r for r, k in zip(rows, labels) if k], [k for k in labels if k]
    # few documents stand in scripts without spaces: parts of them teach what whole ones do
    for body, kind in zip(bodies, list(labels)):
        if kind == "prose" and sum("\u2fff" < c < "\ufb00" for c in body) > 0.25 * len(body):
            for _ in range(5):
                lines = body.split("\n")
                part = "\n".join(line for line in lines if random.random() < 0.6)
                if part.strip() and sum("\u2fff" < c < "\ufb00" for c in part) > 0.2 * len(part):
                    x.append(statistics(part, pairs, scores))
                    y.append("prose")
    size = lambda lines: sum(len("".join(z.split())) for z in lines)
    for _ in range(MIXED):
        kind = random.choice(KINDS[1:])
        prose, other = random.choice(pure["prose"]).split("\n"), random.choice(pure[kind]).split("\n")
        prose, other = prose[: random.randint(1, len(prose))], other[: random.randint(1, len(other))]
        share = size(other) / max(1, size(prose) + size(other))
        if abs(share - 0.5) > 0.04 and (size(prose) + size(other)) > 20:
            mixed = prose + other if random.random() < 0.6 else other + prose
            x.append(statistics("\n".join(mixed), pairs, scores))
            y.append(kind if share > 0.5 else "prose")
    x, y = np.array(x), np.array(y)
    numbers = lambda rows: (np.array([statistics(t, pairs, scores) for _, t in rows]), np.array([k for k, _ in rows]))
    cx, cy = numbers(calibrating)
    fitted = [calibrate(fit_kind(x, (y == k).astype(float)), cx, (cy == k).astype(float)) for k in KINDS]
    model = Trees(fitted)
    for name, (a, b) in (("training", (x, y)), ("calibration", (cx, cy)), ("report", numbers(reporting)), ("written", numbers(HOLDOUT))):
        p = model.probabilities(a)
        guess = np.array(KINDS)[p.argmax(axis=1)]
        brier = float(((p - (b[:, None] == np.array(KINDS))) ** 2).sum(axis=1).mean())
        print(name, len(b), "right:", round(float((guess == b).mean()), 4), "Brier:", round(brier, 4), [(t, g) for t, g in zip(b, guess) if t != g][:10])
    MODEL.write_text(json.dumps({"pairs": pairs, "kinds": fitted}, separators=(",", ":")))


if __name__ == "__main__":
    main(*sys.argv[1:3])
