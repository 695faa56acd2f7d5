"""Licence recognition by sentences, with DataFrame functions alone.

Blank lines and sentence marks before white space break a text (the mark of
``v.`` before a digit does not); a single line end may be a break or a space.
Known normalised sentences are found between breaks, also across the line ends
of a hard-wrapped text, and the sequence of their identifiers is matched against ordered
rules: a rule that matches takes its identifiers, so that the shorter rules
after it see only what is left.

Defined cases: a null or empty text has no licence; repeated rows give one row
each; a null id stays null; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licences by their SPDX identifier, and the class of each.
SPDX = {
    "MIT": "permissive",
    "Apache-2.0": "permissive",
    "BSD-2-Clause": "permissive",
    "BSD-3-Clause": "permissive",
    "ISC": "permissive",
    "Zlib": "permissive",
    "BSL-1.0": "permissive",
    "Unlicense": "permissive",
    "CC0-1.0": "permissive",
    "CC-BY-4.0": "permissive",
    "CC-BY-SA-4.0": "copyleft",
    "CC-BY-NC-4.0": "non-commercial",
    "GPL-2.0-only": "copyleft",
    "GPL-2.0-or-later": "copyleft",
    "GPL-3.0-only": "copyleft",
    "GPL-3.0-or-later": "copyleft",
    "LGPL-2.1-or-later": "copyleft",
    "LGPL-3.0-or-later": "copyleft",
    "AGPL-3.0-only": "copyleft",
    "AGPL-3.0-or-later": "copyleft",
    "MPL-2.0": "copyleft",
    "EPL-2.0": "copyleft",
}
# Normalised sentences of public licence texts and notices, cut at sentence marks.
SENTENCES = {
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl3-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-free": "this program is free software",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl3-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-free": "this library is free software",
    "lgpl-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl3-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "version-2-or-later": "either version 2 of the license or at your option any later version",
    "version-2.1-or-later": "either version 2 1 of the license or at your option any later version",
    "version-3-or-later": "either version 3 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty",
    "gpl-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "lgpl-details": "see the gnu lesser general public license for more details",
    "agpl-details": "see the gnu affero general public license for more details",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc0-waiver": "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work",
    "mit-notice": "released under the mit license",
    "mit-title": "mit license",
    "mit-title-the": "the mit license",
    "mit-notice-by": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache2-notice": "licensed under the apache license version 2 0",
    "apache2-header": "licensed under the apache license version 2 0 the license",
    "apache2-use": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache2-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-language": "see the license for the specific language governing permissions and limitations under the license",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented",
    "zlib-altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "zlib-notice": "this notice may not be removed or altered from any source distribution",
    "bsl-notice": "distributed under the boost software license version 1 0",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "mpl2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "epl2-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "rights-reserved": "all rights reserved",
}
SENTENCES |= {f"spdx-{name}": " ".join(re.findall("[a-z0-9]+", f"spdx license identifier {name}".lower())) for name in SPDX}
# Rules in the order in which they are tried: licence, identifiers in sequence.
RULES = (
    ("GPL-3.0-or-later", ("gpl3-program", "gpl-warranty", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl2-program", "gpl-warranty", "gpl-details")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl3-terms", "gpl-hope", "gpl-implied", "agpl-details")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms", "gpl-hope", "gpl-implied", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-terms", "version-3-or-later", "gpl-hope", "gpl-implied", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-terms", "version-2-or-later", "gpl-hope", "gpl-implied", "gpl-details")),
    ("LGPL-3.0-or-later", ("lgpl-free", "lgpl3-terms", "lgpl-hope", "gpl-implied", "lgpl-details")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-terms", "version-2.1-or-later", "lgpl-hope", "gpl-implied", "lgpl-details")),
    ("Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("Apache-2.0", ("apache2-header", "apache2-use", "apache2-copy", "apache2-as-is", "apache2-language")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("MIT", ("mit-grant", "mit-condition", "mit-as-is", "mit-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("Apache-2.0", ("apache2-header", "apache2-use", "apache2-copy")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-terms", "version-2.1-or-later")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-terms", "version-2-or-later")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-terms", "version-3-or-later")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("Apache-2.0", ("apache2-header", "apache2-use")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl3-terms")),
    ("LGPL-3.0-or-later", ("lgpl-free", "lgpl3-terms")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms")),
    ("GPL-3.0-or-later", ("gpl3-program",)),
    ("GPL-2.0-or-later", ("gpl2-program",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-by",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-title-the",)),
    ("Apache-2.0", ("apache2-header",)),
    ("Apache-2.0", ("apache2-notice",)),
    ("ISC", ("isc-grant",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("BSL-1.0", ("bsl-notice",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("EPL-2.0", ("epl2-notice",)),
    ("Unlicense", ("unlicense",)),
)
RULES += tuple((name, (f"spdx-{name}",)) for name in SPDX)
RULES += (("Proprietary", ("rights-reserved",)),)
RULES = tuple((name, SPDX.get(name, "proprietary"), ids) for name, ids in RULES)


_BREAK, _LINE = "\x01", "\x02"


def _sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in its order."""
    known = F.create_map(*[F.lit(x) for sid, sentence in SENTENCES.items() for x in (sentence, sid)])
    # The colon of an SPDX line and the point of "v. 2.0" end no sentence, nor does the blank line before an address.
    text = F.replace(F.regexp_replace(text, r"[\x01\x02\r]", " "), F.lit("SPDX-License-Identifier:"), F.lit("SPDX-License-Identifier"))
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)\bv\.\s+(?=[0-9])", "v "), r"(?i)\bat:?[ \t]*\n\s*(?=https?://)", "at ")
    text = F.regexp_replace(F.regexp_replace(text, r"[.;:!?](?=[ \t\n]|$)", _BREAK), r"\n[ \t]*+\n", _BREAK)
    plain = F.regexp_replace(F.lower(F.regexp_replace(text, "\n", _LINE)), r"[^a-z0-9\x01\x02]+", " ")
    sentences = "|".join(s.replace(" ", r"[ \x02]+") for s in sorted(SENTENCES.values(), key=len, reverse=True))
    # A match takes the break before it and leaves the one after it to the next.
    found = F.regexp_extract_all(F.concat(F.lit(_BREAK), plain, F.lit(_BREAK)), F.lit(rf"[\x01\x02] ?(?:{sentences})(?= ?[\x01\x02])"), F.lit(0))
    return F.transform(found, lambda s: F.try_element_at(known, F.trim(F.regexp_replace(s, r"[ \x01\x02]+", " "))))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, licences, classes, unmatched): arrays in the order of the rules or the text."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _sentence_ids(F.coalesce("text", F.lit(""))).alias("sentence_ids"))
    rules = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(kind).alias("class"), F.lit("".join(f"[{s}]" for s in seq)).alias("pattern")) for name, kind, seq in RULES])
    start = F.struct(F.array_join(F.transform("sentence_ids", lambda s: F.concat(F.lit("["), s, F.lit("]"))), "").alias("left"), F.array().cast("array<struct<licence:string,class:string,n:long>>").alias("hits"))

    def apply(now: Column, rule: Column) -> Column:
        left = F.replace(now["left"], rule["pattern"], F.lit("|"))
        n = ((F.length(now["left"]) - F.length(left)) / (F.length(rule["pattern"]) - 1)).cast("long")
        hit = F.array(F.struct(rule["licence"].alias("licence"), rule["class"].alias("class"), n.alias("n")))
        return F.when(n > 0, F.struct(left.alias("left"), F.concat(now["hits"], hit).alias("hits"))).otherwise(now)

    matched = F.when(F.size("sentence_ids") > 0, F.aggregate(rules, start, apply)).otherwise(start)
    out = found.select("doc_id", "sentence_ids", matched.alias("m"))
    return out.select(
        "doc_id",
        "sentence_ids",
        F.array_distinct(F.transform("m.hits", lambda h: h["licence"])).alias("licences"),
        F.array_sort(F.array_distinct(F.transform("m.hits", lambda h: h["class"]))).alias("classes"),
        F.aggregate("m.hits", F.lit(0).cast("long"), lambda total, h: total + h["n"]).alias("n_matches"),
        F.size(F.array_remove(F.split(F.regexp_replace("m.left", r"[\[|]", ""), "]"), "")).cast("long").alias("n_unmatched"),
    )
