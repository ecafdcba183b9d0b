import itertools
import random
import re

from cairnlore.llm import licences, queries


def made():
    return {k: licences.Template(v) for k, v in licences.TEMPLATES.items()}


def test_increasing_is_longest():
    rng = random.Random(1)
    for _ in range(60):
        ys = rng.sample(range(20), rng.randint(0, 8))
        got = licences.increasing(list(enumerate(ys)))
        best = max((len(c) for n in range(len(ys) + 1) for c in itertools.combinations(range(len(ys)), n) if all(ys[a] < ys[b] for a, b in zip(c, c[1:]))), default=0)
        assert len(got) == best and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:]))


def test_align_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randint(0, 14))] for _ in "ab")
        pairs = licences.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    words = [f"w{i}" for i in range(50)]
    changed = words[:10] + ["x"] + words[11:30] + ["y", "z"] + words[30:]
    assert len(licences.align(words, changed)) == 49


def found(text):
    return [m[:2] for m in licences.scan_text(text, made())]


def test_whole_and_changed_texts_are_found():
    rng, templates = random.Random(3), made()
    filler = lambda n: " ".join("".join(rng.choices("qzxjk", k=4)) for _ in range(n))
    for name, text in licences.TEMPLATES.items():
        words, own = text.split(), name.split("/")[0]
        doc = filler(500) + " " + text + " " + filler(300) + "\n" + text.upper() + " " + text
        got = licences.scan_text(doc, templates)
        assert [m[:2] for m in got] == [(own, 1.0)] * 3, name
        assert licences.WORDS.findall(doc[got[0][2] : got[0][3]]) == licences.WORDS.findall(text)
        if len(words) > 40:
            fewer = [w for w in words if rng.random() > 0.08 or templates[name].telling & set(licences.WORDS.findall(w.lower()))]
            hit = licences.scan_text(filler(50) + " " + " ".join(fewer), templates)
            assert len(hit) == 1 and hit[0][0] == own and 0.8 <= hit[0][1] <= 1, name
    assert licences.scan_text(filler(3000), templates) == []
    assert licences.scan_text("the license under version of this work is all", templates) == []


def test_telling_words_decide():
    commons = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    assert found(commons.format("-ShareAlike")) == [("CC-BY-SA-4.0", 1.0)]
    assert found(commons.format("-NonCommercial")) == [("CC-BY-NC-4.0", 1.0)]
    assert found(commons.format("")) == [("CC-BY-4.0", 1.0)]
    assert found("This work is licensed under the GNU General Public License, version 2.") == [("GPL-2.0", 1.0)]
    assert found("Licensed under CC BY 4.0.") == [("CC-BY-4.0", 1.0)]
    assert found("Released under the BSD License.") == [("BSD", 1.0)]
    assert found("Released under the License.") == found("Licensed under CC BY 3.0.") == found("This work is licensed under the GNU General Public License, version 7.") == []
    assert licences.scan_text("İ Released under the MIT License", made())[0][2:] == (2, 32)


def test_versions_tell_in_every_template():
    mpl, gpl, apache = (licences.TEMPLATES[k] for k in ("MPL-2.0/header", "GPL-2.0/header", "Apache-2.0/header"))
    assert found(mpl) == [("MPL-2.0", 1.0)] and found(mpl.replace("v. 2.0", "v. 1.1")) == []
    assert found(gpl.replace("version\n            2", "version 4")) == [] != found(gpl)
    assert found(gpl.replace("version\n            2", "version 3")) == [("GPL-3.0", 1.0)]
    assert found(apache.replace("Version 2.0", "Version 1.1")) == []
    # Numbers that are no versions don't.
    assert [k for k, _ in found(licences.TEMPLATES["BSD-2-Clause/text"].replace("Redistributions in", "2. Redistributions in"))] == ["BSD-2-Clause"]


def test_spdx_expressions():
    names = {x.lower(): x for x in licences.SPDX}
    told = lambda t: [m[0] for m in licences.identified(t, names)]
    assert told("// SPDX-License-Identifier: MIT OR Apache-2.0\nMIT code") == ["MIT", "Apache-2.0"]
    assert told("SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND (bsd-3-clause OR ISC)") == ["GPL-2.0", "BSD-3-Clause", "ISC"]
    assert told("# SPDX-License-Identifier: LGPL-2.1-or-later, SPDX-License-Identifier: GPL-3.0+") == ["LGPL-2.1", "GPL-3.0"]
    assert told("SPDX-License-Identifier: Unknown-1.0 and more") == told("SPDX-License-Identifier:") == told(None) == []
    text = "x SPDX-License-Identifier: MIT and more"
    assert [text[s:e] for _, _, s, e in licences.identified(text, names)] == ["MIT"]


def test_inserted_words_count():
    assert found("This work is hereby licensed under the GNU General Public License, version 3.") == [("GPL-3.0", 12 / 13)]
    assert found("This work is " + "surely and " * 3 + "licensed under the GNU General Public License, version 3.") == []


def test_of_overlapping_matches_the_fullest_stays():
    three = licences.TEMPLATES["BSD-3-Clause/text"]
    assert found(three) == [("BSD-3-Clause", 1.0)] and found(licences.TEMPLATES["BSD-2-Clause/text"]) == [("BSD-2-Clause", 1.0)]
    assert found(licences.TEMPLATES["Apache-2.0/header"]) == [("Apache-2.0", 1.0)]


def common(a, b):
    """The length of the longest common subsequence, by the whole table."""
    before = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(before[j] + 1 if x == y else max(before[j + 1], now[j]))
        before = now
    return before[-1]


#: Words of the longest template that the plain search tries.
NOTICE = 30


def plain_notices(text):
    """The notices in a text by trying every stretch of about their length, and plain SPDX identifiers."""
    words, out = licences.WORDS.findall((text or "").lower()), set(re.findall(r"SPDX-License-Identifier: ([A-Za-z0-9.-]+[A-Za-z0-9])", text or ""))
    for name, t in made().items():
        n = len(t.words)
        if n > NOTICE or not t.telling <= set(words):
            continue
        for size in range(n - 2, n + 4):
            for at in range(len(words) - size + 1):
                part = words[at : at + size]
                if len(set(part) & set(t.words)) < 0.7 * len(set(t.words)):
                    continue
                k = common(t.words, part)
                if k >= licences.COVERAGE * (n + size - k) - 1e-9 and t.telling <= set(part) and not any(t.tells(w) and w not in t.words for w in part) and not any(part[j] not in t.words for j in licences.versions(part)):
                    out.add(name.split("/")[0])
    return out


def test_notices_against_brute_force():
    rng = random.Random(5)
    notices = [t for k, t in licences.TEMPLATES.items() if len(licences.WORDS.findall(t)) <= NOTICE]
    for _ in range(150):
        words = rng.choice(notices).rstrip(".").split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(words) + 1)
            words = rng.choice([words[:at] + ["indeed"] + words[at:], words[:at] + words[at + 1 :]]) or ["x"]
        text = "some words before " + " ".join(words) + " and some behind it"
        assert {k for k, _ in found(text)} == plain_notices(text), text


def test_operator_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "All rights reserved. " * 3), (3, "All rights reserved. " * 3), (None, "x " * 100_000 + "Released under the MIT License.")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, license string")
    got = licences.scan(df, ["doc_id"]).collect()
    assert sorted((str(r.doc_id), r.license) for r in got) == sorted([("3", "reserved")] * 6 + [("None", "MIT")])
    assert licences.scan(df.limit(0), ["doc_id"]).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {}
    for r in queries.op2_license_scan(spark, sf_dir).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
        assert 0.8 <= r.coverage <= 1 and docs[r.doc_id][r.start : r.end]
    want = {d: x for d, t in docs.items() if (x := plain_notices(t))}
    assert got == want and want
