"""Licence scans by sentence rules, with DataFrame functions only.

Every text is cut into sentences at full stops, exclamation and question marks
before white space or the end, and that twice: once with each line feed as a
further end (for notices on lines of their own), once with empty lines only
(for texts with wrapped lines).  A sentence is normalised to lower-case ASCII
letters and digits, single spaces between.  Normalised sentences that are
known become identifiers: those of licence texts and headers (``SENTENCES``),
of the GNU and Creative Commons families by name and version, of short notices
("Licensed under the ...") and of SPDX lines; a licence rule is a sequence of identifiers, and it
matches where either sequence of a text, unknown sentences left out, holds it
without a gap.  Rules are ordered: the first that matches names the text's
licence, and all that match are listed, but for those whose sequence lies in
that of another one that matches.  A text without a licence that says "All
rights reserved" in a sentence of its own gets that notice's name, which is no
licence.  A version's "+" reads "or later".

Null and empty texts have no sentences and no licence; texts are read whole
whatever their length; repeated rows match alike; rules that match a text
equally well rank as they are listed; other columns stay, and those with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and of common notices, as their texts have them.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "apache-2-obtain": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "apache-2-header-line": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-2-asf": "The ASF licenses this file to you under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "apache-2-obtain-at": "You may obtain a copy of the License at",
    "apache-2-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2-url-s": "https://www.apache.org/licenses/LICENSE-2.0",
    "apache-2-obtain-unless": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-2-obtain-unless-s": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-2-limits": "See the License for the specific language governing permissions and limitations under the License",
    "apache-2-title": "Version 2.0, January 2004",
    "apache-1.1-title": "The Apache Software License, Version 1.1",
    "perl-terms": "This program is free software; you can redistribute it and/or modify it under the same terms as Perl itself",
    "perl-library-terms": "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself",
    "cc0-law": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc0-title": "CC0 1.0 Universal",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-names-university": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-names-holders": "Neither the names of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-names-project": "Neither the name of the project nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-names-rest": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-names-author": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-advertising-uc": "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the University of California, Berkeley and its contributors",
    "bsd-no-patents": "NO EXPRESS OR IMPLIED LICENSES TO ANY PARTY'S PATENT RIGHTS ARE GRANTED BY THIS LICENSE",
    "ncsa-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers",
    "ncsa-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimers in the documentation and/or other materials provided with the distribution",
    "mit-0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "x11-name": "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "postgres-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "unlicense-domain": "This is free and unencumbered software released into the public domain",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "number-2-0": "2.0",
    "number-1-1": "1.1",
    "mpl-2-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "mpl-2-obtain-http": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "mpl-2-title": "Mozilla Public License Version 2.0",
    "mpl-1.1-header": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License",
    "mpl-1.0-header": "The contents of this file are subject to the Mozilla Public License Version 1.0 (the \"License\"); you may not use this file except in compliance with the License",
    "epl-1-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl-2-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl-2-header-with": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0/",
    "cddl-1-header": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\")",
    "artistic-2-title": "The Artistic License 2.0",
    "ofl-1.1-notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "psf-2-title": "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2",
    "ms-pl-title": "Microsoft Public License (Ms-PL)",
    "all-rights": "All rights reserved",
}
# Names and versions of the GNU licences, and the dates that their titles carry.
GNU = {
    "GPL": ("GNU General Public License", {"1": "February 1989", "2": "June 1991", "3": "29 June 2007"}),
    "LGPL": ("GNU Lesser General Public License", {"2.1": "February 1999", "3": "29 June 2007"}),
    "LGPL-2.0": ("GNU Library General Public License", {"2": "June 1991"}),
    "AGPL": ("GNU Affero General Public License", {"3": "19 November 2007"}),
}
# Creative Commons licences by code, as versions up to 3.0 and since spell them.
CC = {
    "BY": ("Attribution",), "BY-SA": ("Attribution-ShareAlike", "Attribution-Share Alike"), "BY-NC": ("Attribution-NonCommercial",), "BY-ND": ("Attribution-NoDerivatives", "Attribution-NoDerivs", "Attribution-No Derivative Works"),
    "BY-NC-SA": ("Attribution-NonCommercial-ShareAlike", "Attribution-Noncommercial-Share Alike"), "BY-NC-ND": ("Attribution-NonCommercial-NoDerivatives", "Attribution-NonCommercial-NoDerivs", "Attribution-Noncommercial-No Derivative Works"),
}
CC_VERSIONS = {"1.0": ("Generic",), "2.0": ("Generic",), "2.5": ("Generic",), "3.0": ("Unported",), "4.0": ("International",)}
# Identifiers that SPDX lines name, beside the families above.
SPDX = (
    "0BSD", "AFL-3.0", "Apache-1.1", "Apache-2.0", "Artistic-1.0-Perl", "Artistic-2.0", "BSD-1-Clause", "BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause", "BSL-1.0", "BUSL-1.1", "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "CPL-1.0", "ECL-2.0", "EPL-1.0", "EPL-2.0",
    "EUPL-1.1", "EUPL-1.2", "HPND", "ISC", "MIT", "MIT-0", "MPL-1.0", "MPL-1.1", "MPL-2.0", "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA", "ODbL-1.0", "OFL-1.1", "OSL-3.0", "PostgreSQL", "Python-2.0", "SSPL-1.0", "UPL-1.0", "Unicode-DFS-2016", "Unlicense", "Vim", "WTFPL", "X11", "ZPL-2.1", "Zlib",
)
#: Choices that SPDX lines often name.
EITHER = (("MIT", "Apache-2.0"), ("Apache-2.0", "MIT"), ("GPL-2.0", "MIT"), ("GPL-2.0", "BSD-2-Clause"), ("GPL-2.0", "BSD-3-Clause"), ("GPL-2.0-only", "MIT"), ("GPL-2.0-only", "BSD-2-Clause"), ("GPL-2.0-only", "BSD-3-Clause"), ("BSD-3-Clause", "GPL-2.0"))
# Names in short notices.
NAMES = {
    "MIT": ("MIT License", "MIT license (MIT)"), "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"), "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"), "ISC": ("ISC License",), "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, Version 2.0"), "MPL-1.1": ("Mozilla Public License 1.1", "Mozilla Public License, Version 1.1"),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License, Version 1.0"), "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"), "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0"), "Unlicense": ("Unlicense", "The Unlicense"), "Zlib": ("zlib License",),
    "Artistic-2.0": ("Artistic License 2.0",), "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"), "EUPL-1.2": ("EUPL-1.2", "EUPL, Version 1.2"), "PostgreSQL": ("PostgreSQL License",), "CDDL-1.0": ("Common Development and Distribution License, Version 1.0",),
}
NOTICES = ("Licensed under the {}", "Released under the {}", "Distributed under the {}", "This work is licensed under the {}", "This project is licensed under the {}", "This software is licensed under the {}", "This program is licensed under the {}", "This code is licensed under the {}")
SUBJECTS = ("This program", "This library", "This software", "This file")
#: In order: longer and stricter sequences first; those of the GNU licences come before, of other families and of notices after.
RULES_OF_TEXTS: list[tuple[str, tuple[str, ...]]] = [
    ("MPL-2.0", ("mpl-form", "number-2-0")),
    ("MPL-2.0", ("mpl-2-obtain",)),
    ("MPL-2.0", ("mpl-2-obtain-http",)),
    ("MPL-2.0", ("mpl-2-title",)),
    ("MPL-1.1", ("mpl-form", "number-1-1")),
    ("MPL-1.1", ("mpl-1.1-header",)),
    ("MPL-1.0", ("mpl-1.0-header",)),
    ("Apache-2.0", ("notice Apache-2.0", "apache-2-obtain", "apache-2-limits")),
    ("Apache-2.0", ("apache-2-obtain-at", "apache-2-url", "apache-2-limits")),
    ("Apache-2.0", ("apache-2-obtain-at", "apache-2-url-s", "apache-2-limits")),
    ("Apache-2.0", ("apache-2-obtain-unless",)),
    ("Apache-2.0", ("apache-2-obtain-unless-s",)),
    ("Apache-2.0", ("apache-2-header",)),
    ("Apache-2.0", ("apache-2-header-line",)),
    ("Apache-2.0", ("apache-2-asf",)),
    ("Apache-2.0", ("notice Apache-2.0",)),
    ("Apache-2.0", ("apache-2-title",)),
    ("Apache-1.1", ("apache-1.1-title",)),
    ("EPL-2.0", ("epl-2-header",)),
    ("EPL-2.0", ("epl-2-header-with",)),
    ("EPL-1.0", ("epl-1-header",)),
    ("CDDL-1.0", ("cddl-1-header",)),
    ("BSD-4-Clause-UC", ("bsd-source", "bsd-binary", "bsd-advertising-uc")),
    ("BSD-3-Clause-Clear", ("bsd-source", "bsd-binary", "bsd-names", "bsd-no-patents")),
    *(("BSD-3-Clause", ("bsd-source", "bsd-binary", n)) for n in ("bsd-names", "bsd-names-university", "bsd-names-holders", "bsd-names-project", "bsd-names-rest", "bsd-names-author")),
    ("BSD-2-Clause", ("bsd-source", "bsd-binary")),
    ("BSD-1-Clause", ("bsd-source",)),
    ("NCSA", ("ncsa-source", "ncsa-binary")),
    ("X11", ("mit-grant", "mit-condition", "as-is", "x11-name")),
    ("MIT", ("mit-grant", "mit-condition", "as-is")),
    ("MIT", ("mit-condition", "as-is")),
    ("MIT", ("notice MIT",)),
    ("MIT-0", ("mit-0-grant",)),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-notice",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-and",)),
    ("0BSD", ("0bsd-grant",)),
    ("PostgreSQL", ("postgres-grant",)),
    ("Unlicense", ("unlicense-domain",)),
    ("Zlib", ("zlib-warranty", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("CC0-1.0", ("cc0-law",)),
    ("CC0-1.0", ("cc0-title",)),
    ("Artistic-2.0", ("artistic-2-title",)),
    ("Artistic-1.0-Perl", ("perl-terms",)),
    ("Artistic-1.0-Perl", ("perl-library-terms",)),
    ("OFL-1.1", ("ofl-1.1-notice",)),
    ("Python-2.0", ("psf-2-title",)),
    ("MS-PL", ("ms-pl-title",)),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END, REST, AROUND = r"[.!?]+([ \t-\r]|\z)", r"[^a-z0-9\n]+", r" *\n *"


def normalised(sentence: str) -> str:
    """A known sentence as it is found in texts."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).split())


def normal_lines(text: F.Column) -> F.Column:
    """The text normalised, with one line feed at each of its own and two at a sentence's end."""
    t = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    t = F.replace(F.replace(t, F.lit("0+"), F.lit("0 or later")), F.lit("1+"), F.lit("1 or later"))
    t = F.regexp_replace(t, END, "\n\n")
    return F.btrim(F.regexp_replace(F.regexp_replace(t, REST, " "), AROUND, "\n"), F.lit(" \n"))


def lines(t: F.Column) -> F.Column:
    return F.filter(F.split(t, "\n"), lambda s: s != "")


def paragraphs(t: F.Column) -> F.Column:
    return F.filter(F.split(F.translate(F.regexp_replace(t, "\n\n+", "|"), "\n", " "), "[|]"), lambda s: s != "")


def version(v: str) -> str:
    return v if "." in v else v + ".0"


def families() -> Iterator[tuple[str, str, str]]:
    """(identifier, licence, sentence) of the GNU and Creative Commons licences, of notices and of SPDX lines."""
    names = {name: list(forms) for name, forms in NAMES.items()}
    spdx = list(SPDX)
    for family, (name, dates) in GNU.items():
        for v, date in dates.items():
            base = f"{family.partition('-')[0]}-{version(v)}"
            spdx += [f"{base}-only", f"{base}-or-later"]
            yield f"spdx {base}-only", f"{base}-only", f"SPDX-License-Identifier: {base}"
            yield f"title {base}", f"{base}-only", f"{name} Version {v}, {date}"
            names.setdefault(f"{base}-only", []).extend((f"{name}, version {v}", f"{name}, version {version(v)}", f"{name} v{v}", f"{name} v{version(v)}"))
            names.setdefault(f"{base}-or-later", []).append(f"{name}, version {v} or later")
            for subject in SUBJECTS:
                terms = f"{subject} is free software: you can redistribute it and/or modify it under the terms of the {name}"
                yield f"header {base}-or-later", f"{base}-or-later", f"{terms} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version"
                for only in (f"{terms} as published by the Free Software Foundation, version {v}", f"{terms} as published by the Free Software Foundation, version {v} of the License", f"{terms}, version {v}, as published by the Free Software Foundation"):
                    yield f"header {base}-only", f"{base}-only", only
    for code, types in CC.items():
        for v, kinds in CC_VERSIONS.items():
            licence = f"CC-{code}-{v}"
            spdx.append(licence)
            forms = [f"{t} {v} {k}License" for t in types for k in (*(f"{k} " for k in kinds), "")]
            for form in forms:
                for start in ("This work is licensed under a", "This work is licensed under the", "Licensed under a", "Licensed under the"):
                    yield f"notice {licence}", licence, f"{start} Creative Commons {form}"
            for start in ("Licensed under", "This work is licensed under", "Released under"):
                yield f"notice {licence}", licence, f"{start} CC {code} {v}"
    for name, forms in names.items():
        for notice in NOTICES:
            for form in forms:
                yield f"notice {name}", name, notice.format(form)
    for name in spdx:
        yield f"spdx {name}", name, f"SPDX-License-Identifier: {name}"
    yield "spdx GPL-2.0-only", "GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note"
    for two in EITHER:
        for name in two:
            yield f"spdx {' or '.join(two)}", "GPL-2.0-only" if name == "GPL-2.0" else name, f"SPDX-License-Identifier: {two[0]} OR {two[1]}"


# Titles of licences that carry none of the names above, as sentences of their own.
TITLES = {
    "MIT": ("MIT License", "The MIT License (MIT)", "MIT License (MIT)"), "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"), "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License"), "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License"),
    "BSL-1.0": ("Boost Software License - Version 1.0",), "Unlicense": ("The Unlicense",), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"), "MIT-0": ("MIT No Attribution",), "PostgreSQL": ("The PostgreSQL License",),
}


def titles() -> Iterator[tuple[str, str, str]]:
    """(identifier, licence, sentence) of titles, and of lines "License: ..."."""
    for name, forms in TITLES.items():
        for form in forms:
            yield f"title {name}", name, form
    for name in SPDX:
        yield f"field {name}", name, f"License: {name}"


def known() -> dict[str, str]:
    """Normalised sentence to identifier; the first that claims a sentence has it."""
    found = {normalised(text): name for name, text in SENTENCES.items()}
    for name, _, text in (*families(), *titles()):
        found.setdefault(normalised(text), name)
    return found


def rules() -> list[tuple[str, str]]:
    """(licence, identifiers with commas around) in order."""
    of_families = [(licence, (name,)) for name, licence, _ in families()]
    # licences that say "or later" before those that don't, titles last: a title stands in every copy of the text
    of_families.sort(key=lambda r: (r[1][0].startswith("title"), not r[0].endswith("or-later")))
    gnu = [r for r in of_families if r[0].startswith(("GPL", "LGPL", "AGPL")) and not r[1][0].startswith("title")]
    of_titles = [(licence, (name,)) for name, licence, _ in titles()]
    every = [*gnu, *RULES_OF_TEXTS, *of_families, *of_titles]
    return [(licence, "," + ",".join(seq) + ",") for licence, seq in dict.fromkeys(every)]


#: What a text is said to be that names no licence but says ``all-rights``: a notice, no licence.
NOTICE = "all-rights-reserved"


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_sentences, sentence_ids and wrapped_ids (joined by commas), licenses (the same, in the rules' order) and license."""
    ids = known()
    table = F.create_map(*(F.lit(x) for pair in ids.items() for x in pair))

    def hits(found: F.Column) -> F.Column:
        return F.array_join(F.transform(F.filter(found, lambda s: s.isin(*ids)), lambda s: F.element_at(table, s)), ",")

    found = df.withColumn("__t", normal_lines(F.col(text))).withColumn("__s", lines(F.col("__t")))
    found = found.withColumns({"n_sentences": F.size("__s").cast("long"), "sentence_ids": hits(F.col("__s")), "wrapped_ids": hits(paragraphs(F.col("__t")))}).drop("__t", "__s")
    row = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(",;,"), F.col("wrapped_ids"), F.lit(","))
    every = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(seq).alias("seq")) for name, seq in rules()))
    # a rule whose sequence lies in that of another one that matches says no more
    fits = F.filter(every, lambda r: F.contains(row, r["seq"]))
    alone = F.transform(F.array(fits), lambda m: F.filter(m, lambda r: ~F.exists(m, lambda q: (q["seq"] != r["seq"]) & F.contains(q["seq"], r["seq"]))))
    matched = F.transform(F.get(alone, F.lit(0)), lambda r: r["name"])
    matched = F.when((F.size(matched) == 0) & F.contains(row, F.lit(",all-rights,")), F.array(F.lit(NOTICE))).otherwise(matched)
    some = (F.col("sentence_ids") != "") | (F.col("wrapped_ids") != "")
    found = found.withColumn("__l", F.when(some, F.array_distinct(matched)).otherwise(F.array().cast("array<string>")))
    return found.withColumns({"licenses": F.array_join("__l", ","), "license": F.try_element_at("__l", F.lit(1))}).drop("__l")


def scan_sql() -> str:
    """DuckDB SQL for doc_id and the columns of ``scan`` over ``documents``."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    pairs = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in known().items())
    every = ", ".join(f"({k}, {quoted(name)}, {quoted(seq)})" for k, (name, seq) in enumerate(rules()))

    def hits(name: str, column: str) -> str:
        return f"""{name} AS (
  SELECT r, string_agg(id, ',' ORDER BY pos) AS ids
  FROM (SELECT r, unnest({column}) AS sentence, generate_subscripts({column}, 1) AS pos FROM cut) JOIN known USING (sentence) GROUP BY r)"""

    return f"""
WITH known(sentence, id) AS (VALUES {pairs}), rules(pos, name, seq) AS (VALUES {every}),
norm AS (
  SELECT doc_id, row_number() OVER () AS r, trim(regexp_replace(regexp_replace(regexp_replace(
    replace(replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '0+', '0 or later'), '1+', '1 or later'), '[.!?]+([ \\t-\\r]|\\z)', chr(10) || chr(10), 'g'),
    '[^a-z0-9\\n]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), ' ' || chr(10)) AS t
  FROM documents),
cut AS (
  SELECT doc_id, r, list_filter(string_split(t, chr(10)), lambda s: s <> '') AS s,
    list_filter(string_split(replace(regexp_replace(t, '\n\n+', '|', 'g'), chr(10), ' '), '|'), lambda s: s <> '') AS w
  FROM norm),
{hits("short", "s")}, {hits("long", "w")},
ids AS (
  SELECT doc_id, r, CAST(len(s) AS BIGINT) AS n_sentences, coalesce(short.ids, '') AS sentence_ids, coalesce(long.ids, '') AS wrapped_ids
  FROM cut LEFT JOIN short USING (r) LEFT JOIN long USING (r)),
fits AS (SELECT r, name, seq, pos FROM ids JOIN rules ON contains(',' || sentence_ids || ',;,' || wrapped_ids || ',', seq) WHERE sentence_ids <> '' OR wrapped_ids <> ''),
found AS (SELECT r, name, min(pos) AS pos FROM fits f WHERE NOT EXISTS (SELECT 1 FROM fits q WHERE q.r = f.r AND q.seq <> f.seq AND contains(q.seq, f.seq)) GROUP BY ALL),
named AS (SELECT r, string_agg(name, ',' ORDER BY pos) AS licenses, min_by(name, pos) AS license FROM found GROUP BY r),
noticed AS (SELECT *, CASE WHEN license IS NULL AND contains(',' || sentence_ids || ',;,' || wrapped_ids || ',', ',all-rights,') THEN '{NOTICE}' END AS notice FROM ids LEFT JOIN named USING (r))
SELECT doc_id, n_sentences, sentence_ids, wrapped_ids, coalesce(licenses, notice, '') AS licenses, coalesce(license, notice) AS license FROM noticed
"""
