"""Notices as they stand in real files: other holders, reserved rights, lesser licences, full texts."""

from tradeloom.llm import licences

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
"""
LESSER = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU {kind} General Public
License as published by the Free Software Foundation; either
version {version} of the License, or (at your option) any later version.
"""
CASES = {
    "holder": ("BSD-3-Clause", f"Copyright 2008 Google Inc.  All rights reserved.\n\n{BSD}3. Neither the name of Google Inc. nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission.\n"),
    "university": ("BSD-3-Clause", f"Copyright (c) The Regents of the University of California.\nAll rights reserved.\n\n{BSD}3. Neither the name of the University nor the names of its contributors\n   may be used to endorse or promote products derived from this software\n   without specific prior written permission.\n"),
    "two clauses": ("BSD-2-Clause", f"Copyright (c) 2001, Some One\nAll rights reserved.\n\n{BSD}"),
    "lesser 2.1": ("LGPL-2.1-or-later", LESSER.format(kind="Lesser", version="2.1")),
    "library 2": ("LGPL-2.0-or-later", LESSER.format(kind="Library", version="2")),
    "lesser 3": ("LGPL-3.0-or-later", LESSER.format(kind="Lesser", version="3")),
    "lesser text": ("LGPL-3.0-only", "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n"),
    "apache text": ("Apache-2.0", "\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n"),
    "cc0 text": ("CC0-1.0", "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n    CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE\n"),
    "mozilla 1.1": ("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version\n1.1 (the "License"); you may not use this file except in compliance with\nthe License. You may obtain a copy of the License at\nhttp://www.mozilla.org/MPL/\n\nAll Rights Reserved.\n'),
    "mozilla 2 text": ("MPL-2.0", "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n"),
    "documentation": ("GFDL-1.3-only", "                GNU Free Documentation License\n                 Version 1.3, 3 November 2008\n\n\n"),
    "artistic": ("Artistic-1.0", '\t\t\t The "Artistic License"\n\n\t\t\t\tPreamble\n'),
    "reserved": ("Proprietary", "An internal memo. All rights reserved. Do not share."),
    "reserved on a copyright line": ("", "Copyright (c) 2024 Some One. All rights reserved.\nA story begins."),
    "reserved under a copyright line": ("", "# Copyright (c) 2024 Some One\n# All rights reserved.\nA story begins."),
    "no notice": ("", "Neither the name of the rose nor the names of its petals matter. The artistic license of a poet."),
}


def test_real_notices(spark):
    rows = [(k, text) for k, (_, text) in CASES.items()]
    got = {r.k: ",".join(r.licences) for r in licences.scan(spark.createDataFrame(rows, "k string, text string")).collect()}
    assert {k: v for k, v in got.items() if v != CASES[k][0]} == {}


def test_sql_agrees_on_real_notices(spark):
    import duckdb

    rows = [(i, text) for i, (_, text) in enumerate(CASES.values())]
    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
        want = {r[0]: r[1:] for r in db.execute(f"SELECT doc_id, n_sentences, sentence_ids, licences FROM ({licences.sql()})").fetchall()}
    found = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_sentences, ",".join(r.sentence_ids), ",".join(r.licences)) for r in found} == want
