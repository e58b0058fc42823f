"""License scans with Spark expressions only: ordered signature rules over normalized words.

A text is put in lower case and cut into words, one space apart. Rules are regular expressions over that form: sentences
of licenses and notices one by one, and the forms in which licenses are named, for each family. A rule is tried where its
keyword occurs, and no rule where none of some stems occurs, one of which every match of a rule holds; so most texts
meet only those ``contains``. A detection is an interval of words. Where one detection's interval lies within another's, the longer
one stays, and of equal intervals the one of the rule that comes first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Phrases that always count, with their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
_BASE_AT = "(?<= )(?:" + "|".join(p for p, _ in BASE) + ")(?= )"
_V = "(?: version| v)?"

#: (label, keyword, name, identifier): the words by which a license is called, more special ones first. Each match of the
#: name holds the keyword, with a space at either end.
FAMILIES = [
    ("agpl", "affero", f"gnu affero general public license(?:{_V} 3(?: 0)?)?", "agpl 3 0(?: only| or later)?"),
    ("agpl", "agpl", f"agpl(?:{_V} ?3(?: 0)?)?", "agpl 1 0(?: only| or later)?"),
    ("lgpl", "general public license", f"gnu (?:lesser|library) general public license(?:{_V} (?:2 1|2|3)(?: 0)?)?", "lgpl (?:2 0|2 1|3 0)(?: only| or later)?"),
    ("lgpl", "lgpl", f"lgpl(?:{_V} ?(?:2 1|2|3)(?: 0)?)?", "lgpl (?:2 0|2 1|3 0)(?: only| or later)?"),
    ("gfdl", "documentation license", f"gnu free documentation license(?:{_V} 1 [123])?", "gfdl 1 [123](?: only| or later)?"),
    ("gpl-3.0", "general public license", f"gnu general public license(?: as published by the free software foundation)?{_V} 3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl-2.0", "general public license", f"gnu general public license(?: as published by the free software foundation)?{_V} 2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl", "gpl", f"(?:gnu )?gpl(?:{_V} ?[123](?: 0)?)?", "gpl 1 0(?: only| or later)?"),
    ("apache-2.0", "apache", f"apache(?: software)? license{_V} 2(?: 0)?", "apache 2 0"),
    ("apache-1.1", "apache", f"apache(?: software)? license{_V} 1 1", "apache 1 1"),
    ("mit", "mit ", "mit(?: x11| expat)?", "mit"),
    ("mit-0", "no attribution", "mit no attribution", "mit 0"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)", "bsd 4 clause"),
    ("0bsd", "bsd", "(?:bsd zero clause|zero clause bsd)", "0bsd"),
    ("mpl-2.0", "mozilla public license", f"mozilla public license{_V} 2(?: 0)?", "mpl 2 0"),
    ("mpl-1.1", "mozilla public license", f"mozilla public license{_V} 1 1", "mpl 1 1"),
    ("epl-2.0", "eclipse public license", f"eclipse public license{_V} 2(?: 0)?", "epl 2 0"),
    ("epl-1.0", "eclipse public license", f"eclipse public license{_V} 1(?: 0)?", "epl 1 0"),
    ("eupl", "european union public", f"european union public licen[cs]e(?:{_V} 1 [12])?", "eupl 1 [12]"),
    ("cddl", "common development and distribution", f"common development and distribution license(?:{_V} 1 [01])?", "cddl 1 [01]"),
    ("cpl-1.0", "common public license", f"common public license(?:{_V} 1 0)?", "cpl 1 0"),
    ("isc", "isc ", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib"),
    ("bsl-1.0", "boost", f"boost software license(?:{_V} 1 0)?", "bsl 1 0"),
    ("artistic-2.0", "artistic", f"artistic license(?:{_V} (?:2|1)(?: 0)?)?", "artistic (?:1|2) 0"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("wtfpl", "what the", "do what the [a-z]+ you want to public license", "wtfpl"),
    ("ofl-1.1", "font license", f"(?:sil )?open font license(?:{_V} 1 [01])?", "ofl 1 [01]"),
    ("psf-2.0", "python software foundation", f"python software foundation license(?:{_V} 2)?", "psf 2 0"),
    ("ms-pl", "microsoft public", "microsoft public license", "ms pl"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal license", "ms rl"),
    ("osl-3.0", "open software license", f"open software license(?:{_V} 3 0)?", "osl 3 0"),
    ("afl-3.0", "academic free", f"academic free license(?:{_V} [123] [01])?", "afl 3 0"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?", "ncsa"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("lppl", "latex project", f"latex project public license(?:{_V} 1 [0-3])?", "lppl 1 [0-3]c?"),
    ("odbl", "database license", "open(?: data commons)? (?:open )?database license", "odbl 1 0"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-nc-nd", "nc nd", "cc by nc nd(?: [1234] [05])?", "cc by nc nd [1234] [05]"),
    ("cc-by-nc-sa", "nc sa", "cc by nc sa(?: [1234] [05])?", "cc by nc sa [1234] [05]"),
    ("cc-by-nc", "cc by nc", "cc by nc(?: [1234] [05])?", "cc by nc [1234] [05]"),
    ("cc-by-nd", "cc by nd", "cc by nd(?: [1234] [05])?", "cc by nd [1234] [05]"),
    ("cc-by-sa", "cc by sa", "cc by sa(?: [1234] [05])?", "cc by sa [1234] [05]"),
    ("cc-by", "cc by", "cc by(?: [1234] [05])?", "cc by [1234] [05]"),
    ("cc-by", "creative commons", "creative commons attribution(?: [1234] [05])?(?: international| unported| generic)?", "cc by [1234] [05]"),
    ("cc-by-sa", "share", "creative commons attribution share ?alike(?: [1234] [05])?", "cc by sa [1234] [05]"),
    ("cc-by-nc", "noncommercial", "creative commons attribution noncommercial(?: [1234] [05])?", "cc by nc [1234] [05]"),
    ("public-domain", "public domain", "public domain", "public domain"),
    ("proprietary", "all rights reserved", "all rights reserved", "proprietary"),
]
#: How a license is granted or named; weight of a detection. {n}: the name, {i}: the identifier.
FORMS = [
    ("spdx license identifier {i}", 1.0),
    ("(?:is |are )?(?:dual )?licensed(?: to you)? under (?:the )?(?:terms of )?(?:the )?{n}(?: licen[cs]e)?", 0.95),
    ("(?:released|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{n}(?: licen[cs]e)?", 0.95),
    ("(?:distributed|redistributed|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?{n}(?: licen[cs]e)?", 0.9),
    ("under the (?:terms|conditions)(?: and conditions)? of (?:the )?{n}(?: licen[cs]e)?", 0.9),
    ("licen[cs]e {n}", 0.7),
    ("{n} licen[cs]e", 0.7),
]
#: (label, keyword, regular expression, weight): sentences of license texts and of the notices that stand at the head of
#: files, and addresses of license texts (fixed wordings of the licenses themselves). Each match holds its keyword.
NOTICES = [
    ("mit", "any person obtaining a copy of this software", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1.0),
    ("mit", "copies or substantial portions of the software", "(?:the above copyright notice and )?this permission notice shall be included in all copies or substantial portions of the software", 0.9),
    ("mit", "sell copies of the software", "use copy modify merge publish distribute sublicense and or sell copies of the software", 0.9),
    ("mit", "opensource org licenses mit", "opensource org licenses mit(?: license)?(?: php)?", 0.9),
    ("x11", "except as contained in this notice", "except as contained in this notice the names? of [a-z0-9 ]{1,60} shall not be used in advertising", 0.9),
    ("json", "the software shall be used for good", "the software shall be used for good not evil", 1.0),
    ("isc", "distribute this software for any purpose", "permission to use copy modify (?:and or|and|or) distribute this software for any purpose with or without fee is hereby granted", 1.0),
    ("ntp", "software and its documentation for any purpose", "permission to use copy modify (?:and )?distribute(?: and sell)? this software and its documentation for any purpose", 0.9),
    ("hpnd", "historical permission notice", "historical permission notice and disclaimer", 0.9),
    ("tcl", "modify distribute and license this software", "the authors hereby grant permission to use copy modify distribute and license this software and its documentation", 1.0),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?", 0.95),
    ("bsd", "redistributions of source code must retain", "redistributions of source code must retain the (?:above )?copyright notice", 0.9),
    ("bsd", "redistributions in binary form must reproduce", "redistributions in binary form must reproduce the (?:above )?copyright notice", 0.9),
    ("bsd", "this software is provided by the", "this software is provided by the (?:copyright holders?|author|authors|regents)(?: and contributors)? as is", 0.8),
    ("bsd-3-clause", "endorse or promote products", "neither the names? of [a-z0-9 ]{1,80} may be used to endorse or promote products derived from this software", 1.0),
    ("bsd-4-clause", "all advertising materials mentioning", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1.0),
    ("bsd-4-clause", "software developed by the university of california", "this product includes software developed by the university of california", 0.8),
    ("bsd-2-clause", "opensource org licenses bsd 2", "opensource org licenses bsd 2 clause", 0.9),
    ("bsd-3-clause", "opensource org licenses bsd 3", "opensource org licenses bsd 3 clause", 0.9),
    ("bsd-2-clause-patent", "bsd plus patent", "bsd plus patent(?: license)?", 0.8),
    ("openssl", "software developed by the openssl project", "this product includes software developed by the openssl project", 0.9),
    ("ssleay", "software written by eric young", "this product includes cryptographic software written by eric young", 0.9),
    ("apache-2.0", "agreed to in writing software distributed under the license", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 1.0),
    ("apache-2.0", "each contributor hereby grants to you a perpetual", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide", 1.0),
    ("apache-2.0", "apache org licenses license 2 0", "apache org licenses license 2 0", 0.9),
    ("apache-2.0", "opensource org licenses apache 2 0", "opensource org licenses apache 2 0", 0.9),
    ("llvm-exception", "llvm exception", "with (?:the )?llvm exceptions?", 0.8),
    ("gpl-2.0", "general public license as published", "gnu general public license as published by the free software foundation (?:either )?version 2(?: of the license)?", 1.0),
    ("gpl-3.0", "general public license as published", "gnu general public license as published by the free software foundation (?:either )?version 3(?: of the license)?", 1.0),
    ("lgpl", "general public license as published", "gnu (?:lesser|library) general public license as published by the free software foundation", 1.0),
    ("agpl", "affero general public license as published", "gnu affero general public license as published by the free software foundation", 1.0),
    ("gpl", "this program is free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 0.95),
    ("lgpl", "this library is free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 0.95),
    ("agpl", "this program is free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", 0.95),
    ("gpl", "received a copy of the gnu general public license", "you should have received a copy of the gnu general public license along with this (?:program|library|file)", 0.9),
    ("lgpl", "general public license along with this", "you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|library|file)", 0.9),
    ("agpl", "affero general public license along with this", "you should have received a copy of the gnu affero general public license along with this (?:program|library|file)", 0.9),
    ("agpl", "remote network interaction", "remote network interaction use with the gnu general public license", 0.9),
    ("agpl", "affero gpl", f"(?:gnu )?affero gpl(?:{_V} ?3(?: 0)?)?", 0.7),
    ("agpl", "affero general public license", f"affero general public license(?:{_V} ?3(?: 0)?)?", 0.7),
    ("lgpl", "lesser gpl", f"(?:gnu )?lesser gpl(?:{_V} ?(?:2 1|3)(?: 0)?)?", 0.7),
    ("lgpl", "library gpl", f"(?:gnu )?library gpl(?:{_V} ?2(?: 0)?)?", 0.7),
    ("lgpl", "lesser general public license", f"lesser general public license(?:{_V} ?(?:2 1|3)(?: 0)?)?", 0.7),
    ("gpl-3.0", "gnu org licenses gpl 3", "gnu org licenses gpl 3 0", 0.9),
    ("gpl-2.0", "gnu org licenses", "gnu org licenses (?:old licenses )?gpl 2 0", 0.9),
    ("lgpl", "gnu org licenses", "gnu org licenses (?:old licenses )?lgpl(?: 2 1| 3 0)?", 0.9),
    ("agpl", "gnu org licenses agpl", "gnu org licenses agpl(?: 3 0)?", 0.9),
    ("gpl-classpath-exception", "making a combined work", "linking this library statically or dynamically with other modules is making a combined work", 0.9),
    ("gpl-bison-exception", "all of the bison parser skeleton", "you may create a larger work that contains part or all of the bison parser skeleton", 0.9),
    ("gcc-runtime-exception", "gcc runtime library exception", f"gcc runtime library exception(?:{_V} 3 1)?", 0.9),
    ("fsfap", "permitted in any medium without royalty", "copying and distribution of this file with or without modification are permitted in any medium without royalty", 1.0),
    ("fsful", "gives unlimited permission to copy", "the free software foundation gives unlimited permission to copy and or distribute it", 1.0),
    ("gfdl", "modify this document under the terms of the gnu free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 1.0),
    ("mpl-2.0", "this source code form is subject to the terms", "this source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    ("mpl-2.0", "a copy of the mpl was not distributed", "if a copy of the mpl was not distributed with this file", 0.95),
    ("mpl-2.0", "mozilla org mpl 2 0", "mozilla org mpl 2 0", 0.9),
    ("mpl-1.1", "subject to the mozilla public license version 1 1", "the contents of this file are subject to the mozilla public license version 1 1", 1.0),
    ("mpl-1.0", "subject to the mozilla public license version 1 0", "the contents of this file are subject to the mozilla public license version 1 0", 1.0),
    ("npl", "netscape public license", f"(?:subject to the )?netscape public license(?:{_V} 1 [01])?", 0.9),
    ("epl-2.0", "under the terms of the eclipse public license", "(?:made )?available under the terms of the eclipse public license (?:v|version )?2(?: 0)?", 1.0),
    ("epl-1.0", "under the terms of the eclipse public license", "(?:made )?available under the terms of the eclipse public license (?:v|version )?1(?: 0)?", 1.0),
    ("epl-2.0", "eclipse org legal epl", "eclipse org legal epl (?:v20|2 0)", 0.9),
    ("edl-1.0", "eclipse distribution license", f"eclipse distribution license(?:{_V} 1(?: 0)?)?", 0.9),
    ("cddl", "subject to the terms of the common development", "the contents of this file are subject to the terms of the common development and distribution license", 1.0),
    ("cpl-1.0", "under the terms of the common public license", "available under the terms of the common public license(?: v1 0| version 1 0)?", 0.95),
    ("ipl-1.0", "ibm public license", f"ibm public license(?:{_V} 1 0)?", 0.9),
    ("zlib", "as is without any express or implied warranty", "this software is provided as is without any express or implied warranty", 0.9),
    ("zlib", "origin of this software must not be misrepresented", "the origin of this software must not be misrepresented", 1.0),
    ("zlib", "altered source versions must be plainly marked", "altered source versions must be plainly marked as such", 1.0),
    ("libpng", "png reference library", "the png reference library is supplied as is", 1.0),
    ("ijg", "work of the independent jpeg group", "this software is based in part on the work of the independent jpeg group", 1.0),
    ("ftl", "freetype project", "(?:the )?freetype project license|portions of this software are copyright [0-9 ]{0,20}the freetype project", 0.9),
    ("bsl-1.0", "person or organization obtaining a copy", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", 1.0),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "compile sell or distribute this software", "anyone is free to copy modify publish use compile sell or distribute this software", 1.0),
    ("wtfpl", "you want to", "(?:you just )?do what the [a-z]{2,8} you want to(?: public license)?", 0.9),
    ("beerware", "whatever you want with this stuff", "as long as you retain this notice you can do whatever you want with this stuff", 1.0),
    ("beerware", "beerware", "(?:the )?beerware license", 0.9),
    ("cc0-1.0", "waived all copyright and related", "has waived all copyright and related or neighboring rights", 0.95),
    ("cc0-1.0", "creativecommons org publicdomain zero", "creativecommons org publicdomain zero 1 0", 0.9),
    ("public-domain", "creativecommons org publicdomain mark", "creativecommons org publicdomain mark 1 0", 0.9),
    ("cc-by", "creativecommons org licenses by", "creativecommons org licenses by [1234] [05]", 0.9),
    ("cc-by-sa", "creativecommons org licenses by sa", "creativecommons org licenses by sa [1234] [05]", 0.9),
    ("cc-by-nd", "creativecommons org licenses by nd", "creativecommons org licenses by nd [1234] [05]", 0.9),
    ("cc-by-nc", "creativecommons org licenses by nc", "creativecommons org licenses by nc [1234] [05]", 0.9),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", "creativecommons org licenses by nc sa [1234] [05]", 0.9),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", "creativecommons org licenses by nc nd [1234] [05]", 0.9),
    ("cc-by-nc", "creative commons attribution non commercial", "creative commons attribution non commercial(?: [1234] [05])?", 0.8),
    ("cc-by-nc-sa", "creative commons attribution non", "creative commons attribution non ?commercial share ?alike(?: [1234] [05])?", 0.8),
    ("cc-by-nc-nd", "creative commons attribution non", "creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: [1234] [05])?", 0.8),
    ("cc-by-nd", "creative commons attribution no", "creative commons attribution no ?deriv(?:s|atives|ative works)(?: [1234] [05])?", 0.8),
    ("cc-by", "copy and redistribute the material in any medium", "(?:you are free to )?share copy and redistribute the material in any medium or format", 0.7),
    ("cc-by-sa", "distribute your contributions under the same license", "you must distribute your contributions under the same license as the original", 0.9),
    ("cc-by-nc", "may not use the material for commercial purposes", "you may not use the material for commercial purposes", 0.9),
    ("cc-by-nd", "may not distribute the modified material", "you may not distribute the modified material", 0.9),
    ("cc-sampling-plus", "sampling plus", "creative commons sampling plus 1 0", 0.9),
    ("ofl-1.1", "font software is licensed under the sil", "this font software is licensed under the sil open font license(?: version 1 1)?", 1.0),
    ("ofl-1.1", "sil org ofl", "(?:scripts )?sil org ofl", 0.9),
    ("artistic-1.0", "verbatim copies of the source form of the standard version", "you may make and give away verbatim copies of the source form of the standard version", 0.9),
    ("artistic-1.0", "conditions under which a package may be copied", "the intent of this document is to state the conditions under which a package may be copied", 1.0),
    ("perl", "under the same terms as perl", "(?:redistribute it and or modify it )?under the same terms as perl(?: 5)?(?: itself)?", 0.9),
    ("ruby", "under the same terms as ruby", "(?:redistribute it and or modify it )?under the same terms as ruby(?: itself)?", 0.9),
    ("php-3.01", "of the php license", "this source file is subject to version 3 (?:0|01) of the php license", 1.0),
    ("psf-2.0", "psf is making python", "psf is making python [0-9 ]{0,8}available to licensee on an as is basis", 1.0),
    ("zpl-2.1", "zope public license", f"zope public license(?: zpl)?(?:{_V} 2 [01])?", 0.9),
    ("w3c", "w3c software", "w3c software (?:and document )?(?:notice and )?license", 0.9),
    ("unicode", "unicode inc license agreement", "unicode inc license agreement data files and software", 1.0),
    ("cecill", "cecill", "(?:governed by|under) the cecill(?: [bc])?(?: free software)?(?: license)?", 0.9),
    ("sspl-1.0", "server side public license", f"server side public license(?:{_V} 1)?", 0.95),
    ("busl-1.1", "business source license", f"business source license(?:{_V} 1 1| 1 1)?", 0.95),
    ("elastic-2.0", "elastic license", f"elastic license(?:{_V} 2(?: 0)?| 2 0)?", 0.9),
    ("commons-clause", "commons clause", f"commons clause(?: license condition)?(?:{_V} 1 0| v1 0)?", 0.9),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|perimeter|free trial|strict|internal use|defensive) license(?: 1 0 0)?", 0.95),
    ("openrail", "openrail", "(?:creativeml |bigscience )?openrail(?: m| s| d| plus plus m)?", 0.8),
    ("odc-by", "open data commons attribution", "open data commons attribution license(?: v1 0| 1 0)?", 0.95),
    ("pddl", "public domain dedication and license", "public domain dedication and license(?: v1 0)?", 0.95),
    ("odbl", "opendatacommons org licenses odbl", "opendatacommons org licenses odbl(?: 1 0)?", 0.9),
    ("cdla-permissive", "community data license agreement permissive", "community data license agreement permissive(?:(?: version)? [12] 0)?", 0.95),
    ("cdla-sharing", "community data license agreement sharing", "community data license agreement sharing(?:(?: version)? 1 0)?", 0.95),
    ("ogl-uk", "open government licence", "open government licence(?: v?[123](?: 0)?)?", 0.9),
    ("etalab", "licence ouverte", "licence ouverte(?: open licence)?(?: 2 0)?", 0.9),
    ("dl-de", "datenlizenz deutschland", "datenlizenz deutschland(?: namensnennung| zero)?(?: 2 0)?", 0.9),
    ("apsl-2.0", "apple public source license", f"apple public source license(?:{_V} (?:2 0|1 [012]))?", 0.9),
    ("ecl-2.0", "educational community license", f"educational community license(?:{_V} 2 0)?", 0.9),
    ("nasa-1.3", "nasa open source agreement", f"nasa open source agreement(?:{_V} 1 3)?", 0.9),
    ("qpl-1.0", "q public license", f"q public license(?:{_V} 1 0)?", 0.9),
    ("rpl-1.5", "reciprocal public license", f"reciprocal public license(?:{_V} 1 [15]| 1 [15])?", 0.9),
    ("sleepycat", "sleepycat", "sleepycat(?: public| software)? license", 0.9),
    ("spl-1.0", "sun public license", f"sun public license(?:{_V} 1 0)?", 0.9),
    ("ms-lpl", "microsoft limited public license", "microsoft limited public license", 0.9),
    ("vim", "vim is charityware", "vim is charityware", 1.0),
    ("lppl", "conditions of the latex project", "distributed and or modified under the conditions of the latex project public license", 1.0),
    ("intel", "intel simplified software license", "intel simplified software license", 0.9),
    ("cal-1.0", "cryptographic autonomy license", f"cryptographic autonomy license(?:{_V} 1 0)?", 0.9),
    ("blueoak-1.0", "blue oak model license", f"blue oak model license(?:{_V} 1 0 0| 1 0 0)?", 0.9),
    ("mulan", "mulan", "mulan (?:permissive software|psl|publ) ?(?:license )?(?:v2|version 2|v1)?", 0.8),
    ("us-government", "states government", "(?:is a )?works? of the united states government", 0.8),
    ("us-government", "not subject to copyright protection", "not subject to copyright protection(?: in the united states)?", 0.8),
    ("public-domain", "public domain", "(?:dedicated|released|placed|put) (?:in|to|into) the public domain", 0.8),
    ("eula", "end user license agreement", "end user license agreement", 0.8),
    ("eula", "software is licensed not sold", "(?:this|the) software is licensed not sold", 0.9),
    ("eula", "reverse engineer decompile or disassemble", "(?:may not|shall not|not) reverse engineer decompile or disassemble", 0.8),
    ("proprietary", "proprietary and confidential", "proprietary and confidential", 0.8),
    ("proprietary", "unauthorized copying of this file", "unauthorized copying of this file via any medium is strictly prohibited", 1.0),
    ("proprietary", "may be reproduced", "no part of this (?:publication|book|work|document) may be reproduced", 0.8),
    ("proprietary", "without the prior written permission of", "without the prior written permission of the (?:publisher|author|copyright (?:owner|holder))", 0.7),
]
#: What makes a name a license by itself.
STEMS = ["licen", "cc by", "creative commons", "cc0", "spdx", "public domain", "all rights reserved", "gpl"]
def rules() -> list[tuple[str, str, str, float]]:
    """(label, keyword, regular expression, weight), in order of priority: notices, then forms by form and family.

    Every text that a regular expression matches holds its keyword: that of the name, or how the form with the
    identifier begins.
    """
    at = lambda regex: f"(?<= )(?:{regex})(?= )"
    out = [(label, key, at(regex), weight) for label, key, regex, weight in NOTICES]
    out += [(label, "spdx license identifier" if "{i}" in form else key, at(form.format(n=name, i=ident)), weight) for form, weight in FORMS for label, key, name, ident in FAMILIES]
    # Names that are licenses by themselves.
    return out + [(label, key, at(name), 0.6) for label, key, name, _ in FAMILIES if "licen" in name or any(s in name for s in STEMS)]


def gate() -> list[str]:
    """What a text must hold for any rule to be tried: stems, and the keywords that hold none of them."""
    stems = [*STEMS, "bsd", "software", "permission", "affero", "apache", "creativecommons org", "exception", "redistribut"]
    return stems + sorted({key for _, key, _, _ in rules() if not any(s in key for s in stems)})


GATE = gate()


def normalized(text: Column) -> Column:
    """Words one space apart, with a space at either end; a single space if there are none."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, _GAP, " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _words_before(text: Column) -> Column:
    """Words in a prefix of a normalized text that ends with the space before a word."""
    return _spaces(text) - 1


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) per row of docs.

    Whole texts; null and empty texts have no words and no labels. detections: label, first word and number of words of
    each that stays. score: the largest weight found, 0.6 for a base phrase alone. Nothing is shuffled; null ids and
    repeated rows stay as they are; other columns are not carried; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalized(F.col(text_col)).alias("_t"))
    rows = rows.withColumn("n_words", F.when(F.col("_t") == "  ", F.lit(0).cast("long")).otherwise(_spaces(F.col("_t")) - 1))
    some_stem = reduce(lambda a, b: a | b, [F.contains("_t", F.lit(s)) for s in GATE])
    # From here on other texts are null, and so is all that is drawn from them.
    rows = rows.select("doc_id", "n_words", F.when(some_stem, F.col("_t")).alias("_t"))
    base = F.when(F.col("_t").isNotNull(), F.regexp_extract_all("_t", F.lit(_BASE_AT), 0))
    rows = rows.withColumn("_base", base)
    some = F.size("_base") > 0
    first = F.when(some, _words_before(F.split("_t", _BASE_AT, 2)[0]))
    last = F.when(some, _words_before(F.regexp_extract("_t", f"(?s)^(.*){_BASE_AT}", 1)))
    label = lambda p: reduce(lambda e, x: e.when(p == x[0], x[1]), BASE[1:], F.when(p == BASE[0][0], BASE[0][1]))
    rows = rows.withColumns({"first_word": first, "last_word": last, "_labels": F.coalesce(F.array_sort(F.array_distinct(F.transform("_base", label))), F.array().cast("array<string>"))})
    by_key: dict[str, list[Column]] = {}
    for place, (label_, key, rule, weight) in enumerate(rules()):
        by_key.setdefault(key, []).append(F.struct(F.lit(label_).alias("label"), F.lit(rule).alias("rule"), F.lit(weight).alias("weight"), F.lit(place).alias("place")))
    # Each keyword is looked for once, and only the rules of those that are there are tried.
    table = F.array(*[F.struct(F.lit(key).alias("key"), F.array(*own).alias("rules")) for key, own in by_key.items()])
    named = F.flatten(F.transform(F.filter(table, lambda k: F.contains(F.col("_t"), k["key"])), lambda k: k["rules"]))
    tried = F.when(F.col("_t").isNotNull(), F.filter(named, lambda r: F.regexp_like(F.col("_t"), r["rule"])))

    def hits(r: Column) -> Column:
        found = F.regexp_extract_all(F.col("_t"), r["rule"], F.lit(0))
        between = F.split(F.col("_t"), r["rule"], -1)
        before = lambda i: F.aggregate(F.slice(between, 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + _spaces(x)) + F.aggregate(F.slice(found, 1, i), F.lit(0).cast("long"), lambda a, x: a + _spaces(x)) - 1
        return F.transform(found, lambda m, i: F.struct(r["label"].alias("label"), before(i).alias("at"), (_spaces(m) + 1).alias("n"), r["weight"].alias("weight"), r["place"].alias("place")))

    rows = rows.withColumn("_tried", tried).withColumn("_hits", F.flatten(F.transform("_tried", hits)))
    inside = lambda d, o: (o["at"] <= d["at"]) & (o["at"] + o["n"] >= d["at"] + d["n"]) & ((o["n"] > d["n"]) | ((o["n"] == d["n"]) & (o["place"] < d["place"])))
    rows = rows.withColumn("_kept", F.filter("_hits", lambda d: ~F.exists("_hits", lambda o: inside(d, o))))
    found = F.coalesce(F.transform("_kept", lambda d: d["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("_kept", lambda d: d["weight"])), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", F.when(some, F.size("_base")).otherwise(0).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join("_labels", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("_labels", found)), ",").alias("labels"),
        F.greatest(best, F.when(some, 0.6).otherwise(0.0)).cast("double").alias("score"),
        F.coalesce(F.transform("_kept", lambda d: F.struct(d["label"].alias("label"), d["at"].alias("at"), d["n"].alias("n"))), F.array().cast("array<struct<label:string,at:bigint,n:bigint>>")).alias("detections"),
    )
