import random
import re

from tessera.llm.license_scan import MAX_DRIFT, NOTICES, PHRASES, TEXT_K, scan_licenses

SCHEMA = "doc_id long, text string, row int, hits int, label string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def base(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        own = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_against_brute_force(spark):
    rows = [
        (1, "Released under the MIT License."),
        (2, "mit-license, MIT\nLICENSE; permit license mit licenses éMIT license"),
        (3, None),
        (4, ""),
        (5, "CC BY CC BY cc by-nc 4.0 of the GNU General Public License. GNU General Public x License"),
        (6, "cc"),
        (7, "by cc"),
        (8, "word " * 50_000 + "apache license"),
        (1, "Released under the MIT License."),
        (None, "Apache\x00License"),
        (9, "gnu general public gnu general public license"),
    ]
    got = scan_licenses(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(((i, *base(t)) for i, t in rows), key=str)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in got)


def test_notices_with_inserted_and_changed_words(spark):
    mit, gpl = NOTICES["mit"].split(), NOTICES["gpl"]
    changed = mit[:30] + ["inserted"] + mit[30:60] + ["other"] + mit[61:]
    rows = [(1, "x y z " + " ".join(changed) + " tail"), (2, " ".join(mit[:20])), (3, "a " * 9 + gpl.upper()), (4, NOTICES["bsd"] + " mid " + NOTICES["isc"])]
    got = {r.doc_id: r for r in scan_licenses(frame(spark, rows)).collect()}
    assert got[1].labels == "mit" and 0.75 <= got[1].score < 1
    assert got[2].labels == "" and 0 < got[2].score < 0.75
    assert got[3].labels == "gpl" and got[3].score == 1
    assert got[4].labels == "bsd,isc"


def test_empty_table(spark):
    assert scan_licenses(frame(spark, [])).collect() == []


def method_part(text, min_coverage=0.75):
    """Labels of notices and the best coverage, compared word by word."""
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    labels, best = set(), 0.0
    for label, notice in NOTICES.items():
        own = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), notice))
        places = {}
        for i in range(len(own) - TEXT_K + 1):
            places.setdefault(tuple(own[i : i + TEXT_K]), []).append(i)
        votes = sorted((p - i, i) for p in range(len(words) - TEXT_K + 1) for i in places.get(tuple(words[p : p + TEXT_K]), ()))
        bands, last = [], None
        for diagonal, place in votes:
            if last is None or diagonal - last > MAX_DRIFT:
                bands.append(set())
            bands[-1].add(place)
            last = diagonal
        coverage = max([len(b) / (len(own) - TEXT_K + 1) for b in bands], default=0.0)
        labels |= {label} if coverage >= min_coverage else set()
        best = max(best, coverage)
    return labels, best


def test_labels_and_score_against_brute_force(spark):
    rng = random.Random(10)
    rows = []
    for n in range(150):
        parts = []
        for _ in range(rng.randint(0, 4)):
            words = rng.choice(list(NOTICES.values())).split()
            for _ in range(rng.randint(0, 8)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 2)] = rng.choice([[], ["other"], ["permission", "is"], words[:6]])
            parts += words + rng.choices("the a of software license mit cc by".split(), k=rng.randint(0, 12))
        rows.append((n, " ".join(parts)))
    # notices across the edges of slices, and one word longer than a slice
    rows.append((200, "ab " * 87_370 + NOTICES["gpl"] + " q" * 300_000 + " " + NOTICES["isc"] + "z" * 600_000 + " mit license"))
    rows.append((201, "cc by " * 60_000))
    got = {r.doc_id: r for r in scan_licenses(frame(spark, rows)).collect()}
    for i, text in rows:
        found, best = method_part(text)
        expected = set(filter(None, base(text)[4].split(",")))
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word) == base(text)[:4]
        assert got[i].labels == ",".join(sorted(found | expected)), i
        assert got[i].score == (1.0 if expected else best), i
