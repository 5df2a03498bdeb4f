"""Licences wrapped over several lines of longer texts."""

import textwrap

from cinderplan.llm import license_scan

PROSE = "\n".join("This line %d tells of rivers and of hills" % k for k in range(60))


def test_wrapped_in_longer_texts(spark):
    mit, isc, apache = license_scan.TEMPLATES["MIT"][0], license_scan.TEMPLATES["ISC"][0], license_scan.TEMPLATES["Apache-2.0-notice"][1]
    wrapped = lambda t, n=70: "\n".join("# " + x for x in textwrap.wrap(t, n))
    texts = [
        wrapped(mit) + "\n" + PROSE,
        PROSE + "\n\n" + wrapped(isc, 40) + "\n" + PROSE,
        PROSE + "\n" + wrapped(apache),
        wrapped(mit) + "\n" + PROSE + "\n" + wrapped(mit),
        "\n".join(mit.split()) + "\n" + PROSE,
        PROSE,
        PROSE + "\n" + wrapped(mit[:300]),
        PROSE + "\n" + apache + "\n" + PROSE,
    ]
    d = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    rows = license_scan.matches(d).collect()
    got = sorted((r.doc_id, r.line_no, r.license) for r in rows if r.template_no == (r.license == "Apache-2.0-notice"))
    last = 62 + len(textwrap.wrap(mit, 70)) - 1
    assert got == [(0, 1, "MIT"), (0, 1, "MIT"), (1, 62, "ISC"), (2, 61, "Apache-2.0-notice"), (3, 1, "MIT"), (3, last, "MIT"), (4, 1, "MIT"), (7, 61, "Apache-2.0-notice")]
    assert all(r.dice >= 0.8 and abs(r.dice - 1) < 0.1 for r in rows if r.license in ("MIT", "ISC"))


def test_keys_are_in_all_that_matches():
    """Whatever part of a template a unit has, if it is at the threshold it holds a key."""
    import random

    known = license_scan.templates()
    keys = license_scan.keys(known, 80)
    rng = random.Random(1)
    held = lambda grams: any(k in g.split() if " " not in k else k == g for k in keys for g in grams)
    for _, _, b in known:
        least = license_scan.least_shared(len(b), 80)
        telling = sorted(b, key=held_first(keys))
        assert held(telling[:least])  # even the part that avoids the keys most
        for _ in range(5):
            assert held(rng.sample(b, least))


def test_pattern():
    import re

    words = ["mit license", "mit", "license", "licensed", "b", "the mit"]
    pattern = re.compile("[^a-z0-9]" + license_scan.any_of(words) + "(?![a-z0-9])")
    for text, want in ((" mit", True), (" mitt", False), (" licensed.", True), (" licenses", False), (" the\t- mit x", True), (" bb", False), (" b", True), (" them it", False)):
        assert bool(pattern.search(text)) == want, text


def held_first(keys):
    return lambda g: any(k in g.split() if " " not in k else k == g for k in keys)


def test_full_texts(spark):
    names = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unlicense", "BSL-1.0", "GPL-3.0-header", "AGPL-3.0-header", "MPL-2.0-header"]
    texts = [PROSE + "\n" + "\n".join(textwrap.wrap(license_scan.TEMPLATES[n][0], 76)) + "\n" + PROSE for n in names]
    got = license_scan.matches(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    best = {}
    for r in got:
        if r.line_no in (0, 61) and r.dice > best.get(r.doc_id, (0, ""))[0]:
            best[r.doc_id] = (r.dice, r.license)
    assert [best[k][1] for k in range(len(names))] == names
