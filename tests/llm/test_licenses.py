from tidemark.llm import licenses as li

TEXTS = {name: text for name, kind, text in reversed(li.KNOWN) if kind == "license"}  # of each, the bare text
MIT, ISC = TEXTS["MIT"], TEXTS["ISC"]
COPY = "Copyright (c) 2019-2021 Some One <a@b.c>\n© 2020 Other\n"


def test_whole_texts_and_notices(docs):
    rows = [
        (1, "MIT License\n\n" + COPY + MIT), (2, MIT.replace("sublicense", "sub-licence").upper().replace(",", " ;")), (3, ISC.replace("\n", "\n\n  # ")), (4, "Some prose here.\nlicensed under the apache licence version 2.0\nmore"),
        (5, MIT + " And more."), (6, None), (7, ""), (8, "All rights reserved.\nReleased under the MIT License."), (9, "Copyright law is old.\n" * 5000), (8, "All Rights Reserved!"), (None, "All rights reserved."), (None, MIT),
    ]
    reserved, mit = ("LicenseRef-all-rights-reserved", 1, "LicenseRef-all-rights-reserved"), ("MIT", 1, "MIT")
    got = sorted(((r.doc_id, r.license, r.n_notices, r.notices) for r in li.scanned(docs(rows)).collect()), key=str)
    # Rows that share an id, or have none, are answered each by itself.
    want = [(1, *mit), (2, *mit), (5, None, 1, "MIT"), (3, "ISC", 0, ""), (4, None, 1, "Apache-2.0"), (8, *reserved), (8, None, 2, "LicenseRef-all-rights-reserved,MIT"), (None, *reserved), (None, *mit)]
    assert got == sorted(want, key=str)


def test_own_table_and_empty(docs):
    assert [tuple(r) for r in li.scanned(docs([(1, "Own-Terms, v1")]), [("OWN", "license", "own terms v1")]).collect()] == [(1, "OWN", 1, "OWN")]
    assert li.scanned(docs([(1, "x")]), []).collect() == [] and li.scanned(docs([(1, "x")]).limit(0)).collect() == []


def test_every_licence_under_other_looks(docs):
    """Whole texts, each under changed case, punctuation, line breaks, comment marks, copyright lines and spellings."""
    assert len(TEXTS) >= 20
    rows = []
    for name, text in TEXTS.items():
        british = text.replace("license", "licence").replace("License", "Licence").replace("merchantability", "Merchantability").replace("acknowledgment", "acknowledgement")
        rows += [(len(rows), COPY + "\n\n" + text), (len(rows) + 1, british.upper().replace(",", " ;")), (len(rows) + 2, "\n".join(" * " + x for x in " ".join(text.split()).replace(". ", ".\n").split("\n")))]
    got = {r.doc_id: r.license for r in li.scanned(docs(rows)).collect()}
    copied = {i for i, (_, x) in enumerate(rows) if "copyright (c)" in x.lower() and i % 3 == 2}  # line breaks decide what a copyright line takes with it
    assert {i: list(TEXTS)[i // 3] for i in range(len(rows)) if i not in copied} == {i: got.get(i) for i in range(len(rows)) if i not in copied}


def test_notices_of_several_lines(docs):
    rows = [(1, "Some code.\n# " + li.APACHE_NOTICE.replace("\n", "\n#   ") + "\nmore code"), (2, li.APACHE_NOTICE.split("\n")[0])]
    assert [(r.doc_id, r.license, r.notices) for r in li.scanned(docs(rows)).collect()] == [(1, None, "Apache-2.0")]
