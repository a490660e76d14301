"""Notices as the licences' own texts and files have them."""

from loomscore.llm import license_rules

APACHE = """Copyright 2020 Some One

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
ASF = """Licensed to the Apache Software Foundation (ASF) under one or more
contributor license agreements.  See the NOTICE file distributed with
this work for additional information regarding copyright ownership.
The ASF licenses this file to You under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance with
the License.  You may obtain a copy of the License at

   http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, {}.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
"""
BSD = """Copyright (c) 2020, Some One
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
CC = "This work is licensed under a Creative Commons {} 4.0 International License."
NOTICES = [
    (APACHE, "Apache-2.0"), ("".join(f"# {line}\n" for line in APACHE.split("\n")), "Apache-2.0"), ("/*\n" + "".join(f" * {line}\n" for line in APACHE.split("\n")) + " */\ncode", "Apache-2.0"), (" ".join(APACHE.split()), "Apache-2.0"),
    (APACHE.replace("http:", "https:"), "Apache-2.0"), (APACHE.partition("Licensed")[2].partition("You may")[1] + APACHE.partition("You may")[2], "Apache-2.0"), (ASF, "Apache-2.0"),
    (GPL.format("either version 3 of the License, or\n(at your option) any later version"), "GPL-3.0-or-later"), (GPL.format("version 3"), "GPL-3.0-only"), (GPL.format("version 3 of the License"), "GPL-3.0-only"),
    (MIT, "MIT"), (BSD, "BSD-2-Clause"), (BSD3, "BSD-3-Clause"), (MPL, "MPL-2.0"), (CC.format("Attribution"), "CC-BY-4.0"), (CC.format("Attribution-ShareAlike"), "CC-BY-SA-4.0"), (CC.format("Attribution-NonCommercial"), "CC-BY-NC-4.0"),
    ("Copyright (c) 2020 Some One. All rights reserved.", "all-rights-reserved"), ("Not under the Apache License, Version 2.0 (the \"License\")", None), ("See the License for the specific language governing permissions and limitations under the License.", None),
]


def test_notices(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NOTICES)], "i int, text string")
    assert [r["license"] for r in license_rules.scan(df).orderBy("i").collect()] == [name for _, name in NOTICES]


# Headers and texts as the licences' publishers give them, wrapped as in source files.
GPL2 = """
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
"""
KERNEL = """
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License version 2 as
 * published by the Free Software Foundation.
"""
LGPL = """// This library is free software; you can redistribute it and/or
// modify it under the terms of the GNU Lesser General Public
// License as published by the Free Software Foundation; either
// version 2.1 of the License, or (at your option) any later version.
//
// This library is distributed in the hope that it will be useful,
"""
AGPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU Affero General Public License as published
    by the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""
LIBRARY = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Library General Public
License as published by the Free Software Foundation; either
version 2 of the License, or (at your option) any later version.
"""
ISC = """ISC License

Copyright (c) 2004-2010, Some One

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND ISC DISCLAIMS ALL WARRANTIES WITH
"""
ZERO = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
"""
ZLIB = """  This software is provided 'as-is', without any express or implied
  warranty.  In no event will the authors be held liable for any damages
  arising from the use of this software.

  Permission is granted to anyone to use this software for any purpose,
  including commercial applications, and to alter it and redistribute it
  freely, subject to the following restrictions:

  1. The origin of this software must not be misrepresented; you must not
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
"""
BOOST = """//          Copyright Some One 2004 - 2006.
// Distributed under the Boost Software License, Version 1.0.
//    (See accompanying file LICENSE_1_0.txt or copy at
//          https://www.boost.org/LICENSE_1_0.txt)
"""
MPL11 = """/* The contents of this file are subject to the Mozilla Public License Version
 * 1.1 (the "License"); you may not use this file except in compliance with
 * the License. You may obtain a copy of the License at
 * http://www.mozilla.org/MPL/
 */
"""
EPL2 = """/********************************************************************************
 * Copyright (c) 2020 Some One
 *
 * This program and the accompanying materials are made available under the
 * terms of the Eclipse Public License 2.0 which is available at
 * https://www.eclipse.org/legal/epl-2.0/
 *
 * SPDX-License-Identifier: EPL-2.0
 ********************************************************************************/
"""
POSTGRES = """Permission to use, copy, modify, and distribute this software and its
documentation for any purpose, without fee, and without a written agreement
is hereby granted, provided that the above copyright notice and this paragraph
and the following two paragraphs appear in all copies.
"""
GOOGLE = BSD + """
    * Neither the name of Google Inc. nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
BSD4 = BSD + """
3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
   This product includes software developed by the University of
   California, Berkeley and its contributors.
"""
TITLE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc.
"""
TEXTS = [
    (GPL2, "GPL-2.0-or-later"), (KERNEL, "GPL-2.0-only"), (LGPL, "LGPL-2.1-or-later"), (AGPL, "AGPL-3.0-or-later"), (LIBRARY, "LGPL-2.0-or-later"), (ISC, "ISC"), (ZERO, "0BSD"), (ZLIB, "Zlib"), (UNLICENSE, "Unlicense"), (BOOST, "BSL-1.0"), (MPL11, "MPL-1.1"), (EPL2, "EPL-2.0"),
    (POSTGRES, "PostgreSQL"), (GOOGLE, "BSD-3-Clause"), (BSD4, "BSD-4-Clause-UC"), (TITLE, "GPL-3.0-only"), (TITLE + AGPL.replace("Affero ", ""), "GPL-3.0-or-later"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", "MPL-1.1"),
    ("// SPDX-License-Identifier: GPL-2.0+\nint x;", "GPL-2.0-or-later"), ("/* SPDX-License-Identifier: GPL-2.0 */", "GPL-2.0-only"), ("# SPDX-License-Identifier: Apache-2.0\n#\n", "Apache-2.0"), ("SPDX-License-Identifier: (GPL-2.0 WITH Linux-syscall-note)", "GPL-2.0-only"), ("// SPDX-License-Identifier: LGPL-2.1-or-later\n", "LGPL-2.1-or-later"),
    ("<!-- SPDX-License-Identifier: CC-BY-SA-4.0 -->", "CC-BY-SA-4.0"), ("-- SPDX-License-Identifier: 0BSD", "0BSD"), ("This work is licensed under a Creative Commons Attribution-Share Alike 3.0 Unported License.", "CC-BY-SA-3.0"), ("This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC-BY-NC-ND-4.0"),
    ("This project is licensed under the MIT License.", "MIT"), ("Licensed under the GNU General Public License v2.0.", "GPL-2.0-only"), ("Licensed under the Mozilla Public License, version 2.0.", "MPL-2.0"), ("Distributed under the 3-Clause BSD License!", "BSD-3-Clause"),
    ("It is not licensed under the MIT License.", None), ("SPDX-License-Identifier: Nothing-1.0", None), ("Version 2.0 of the product.", None), ("2.0. 1.1.", None),
]


def test_texts_and_headers(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "i int, text string")
    found = license_rules.scan(df).orderBy("i").collect()
    assert [(r["i"], r["license"]) for r in found] == [(i, name) for i, (_, name) in enumerate(TEXTS)]
    assert found[-1]["licenses"] == ""


def test_choices_repeats_and_a_very_long_text(spark):
    both = "SPDX-License-Identifier: MIT OR Apache-2.0"
    long = "filler words here. " * 100_000 + "\n" + MPL11 + "more. " * 100_000
    df = spark.createDataFrame([(1, both), (1, both), (2, long)], "i int, text string")
    rows = license_rules.scan(df).drop("text").collect()
    assert sorted((r["i"], r["licenses"]) for r in rows) == [(1, "MIT,Apache-2.0"), (1, "MIT,Apache-2.0"), (2, "MPL-1.1")]


def test_many_licences_are_known():
    names = {name for name, _ in license_rules.rules()}
    assert len(names) >= 90 and not any("," in i or ";" in i for i in license_rules.known().values())


def test_titles_parts_and_reserved_rights(spark):
    """A title names its licence, a part of a longer rule's sentences no other one, and reserved rights are no licence."""
    two = license_rules.SENTENCES["bsd-source"] + ".\n" + license_rules.SENTENCES["bsd-binary"] + "."
    cases = [
        ("The MIT License (MIT)", "MIT"), ("MIT License\n\nCopyright (c) 2020 A. All rights reserved.", "MIT"), ("License: MIT", "MIT"), ("License: BSD-3-Clause\nName: x", "BSD-3-Clause"), ("the MIT License", ""), ("ISC License", "ISC"),
        ("Copyright (c) 2020, A\nAll rights reserved.\n\n" + two, "BSD-2-Clause"), (license_rules.SENTENCES["bsd-source"] + ".", "BSD-1-Clause"), ("All rights reserved. My novel.", "all-rights-reserved"), ("License: none", ""),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, text string")
    assert [r["licenses"] for r in license_rules.scan(df).orderBy("i").collect()] == [name for _, name in cases]
