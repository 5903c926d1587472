import re

from quillspark.llm.licenses import TEMPLATES, document_licenses, op10_license_scans, scan_licenses

PLAIN = ["The quick brown fox jumps over the lazy dog.", "General remarks on the public works of the city, version 2 of the text.",
         "He was released from prison under the new law.", "A work of modern art with or without a frame.", "You may obtain a copy of the book at the library."]


def table(spark):
    rows = [(k, "\n".join(PLAIN[j % 5] + f" Item {k * 7 + j}." for j in range(6)), "x") for k in range(60)]
    rows += [(100, "Intro.\n\nReleased under the MIT License.\nOutro.", None), (101, "Licensed under the Apache License, Version 2.0.", ""),
             (102, "  This work is licensed under the GNU General Public License, version 3.  \r\nLicensed under CC BY-NC 4.0.", ""),
             (103, None, None), (104, "", ""), (105, "Released under the MIT License.", ""), (105, "Released under the MIT License.", ""), (None, "Licensed under CC BY-NC 4.0.", ""),
             (106, "A fishing license is required in the whole district, and all rights reserved to the owner of the lake.", ""),
             (107, "word " * 50_000 + "\nReleased under the MIT License.", ""), (108, "REDISTRIBUTION and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, family string")


def test_families_and_unknown(spark):
    got = {r.doc_id: r for r in document_licenses(table(spark)).collect()}
    assert len(got) == 60 + 10
    found = {d: r.findings for d, r in got.items() if r.findings}
    assert found == {100: "2:MIT", 101: "0:Apache-2.0", 102: "0:GPL,1:CC-BY-NC", 105: "0:MIT", None: "0:CC-BY-NC", 107: "1:MIT", 108: "0:BSD"}
    assert got[102].n_licenses == 2 and got[102].families == "CC-BY-NC,GPL"
    assert document_licenses(table(spark).limit(0)).count() == 0


def test_every_template_is_its_own_family(spark):
    flat = [(f, t) for f, ts in sorted(TEMPLATES.items()) for t in ts]
    docs = table(spark).filter("doc_id < 60").select("doc_id", "text").unionByName(
        spark.createDataFrame([(1000 + k, t) for k, (_, t) in enumerate(flat)], "doc_id long, text string"))
    found = {r.doc_id: r.family for r in scan_licenses(docs).filter("confirmed").collect()}
    right = sum(found.get(1000 + k) == f for k, (f, _) in enumerate(flat))
    assert right >= 0.9 * len(flat) and all(d >= 1000 for d in found)


def test_main_path_is_native(spark):
    plan = document_licenses(table(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_op10_finds_the_planted_lines(spark, small):
    lines = {"This work is licensed under the GNU General Public License, version 3.": "GPL", "Released under the MIT License.": "MIT",
             "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in op10_license_scans(spark, small).collect():
        assert r.findings == ",".join(f"{k}:{lines[x.strip()]}" for k, x in enumerate(texts[r.doc_id].split("\n")) if x.strip() in lines)


MIT = ["Permission is hereby granted, free of charge, to any person obtaining a copy", 'of this software and associated documentation files (the "Software"), to deal',
       "in the Software without restriction, including without limitation the rights"]
BSD = ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions are", "met:"]
GPL = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by",
       "the Free Software Foundation, either version 3 of the License, or"]
ISC = ["Permission to use, copy, modify, and/or distribute this software for any", "purpose with or without fee is hereby granted, provided that the above"]


def test_wrapped_notices(spark):
    rows = [(200, "\n".join(["Copyright 2020", "", *MIT])), (201, "/*\n" + "\n".join(" * " + x for x in BSD) + "\n */\nint x;"),
            (202, "\n".join("# " + x for x in GPL) + "\n#\n" + "\n".join("# " + x for x in ISC)), (203, "\r\n".join(["Title", "  ", *ISC, "", "Released under the MIT License.", "more"])),
            (204, "\n\n".join(MIT)), (205, None)]
    docs = table(spark).filter("doc_id < 60").select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.findings for r in document_licenses(docs).collect() if r.findings}
    assert got == {200: "2:MIT", 201: "1:BSD", 202: "0:GPL,4:ISC", 203: "2:ISC,5:MIT"}
