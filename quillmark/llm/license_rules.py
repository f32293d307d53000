"""Signature rules of the licence scan, hand-written.

Each rule: keywords (single words; a text without any of them skips the rule),
pattern, label, priority. Patterns run over lower-cased words between single spaces, with punctuation
gone, so "GPL-3.0-or-later" reads "gpl 3 0 or later". Priorities: 0 hint,
1 name, 2 notice or grant, 3 full identifier with version or a whole notice.
"""

#: Base phrases and their labels (fixed values of the contract).
BASE = [
    ("gnu", "gnu general public license", "gpl"),
    ("apache", "apache license", "apache"),
    ("cc", "cc by", "cc-by"),
    ("license", "mit license", "mit"),
]

_V = r"(?: v(?:ersion)?)? ?"
_SPDX = r"spdx license identifier "

RULES = [
    # GNU family
    ("gnu", r"gnu general public licen[sc]e" + _V + r"1(?: 0)?", "gpl-1.0", 3),
    ("gnu", r"gnu general public licen[sc]e" + _V + r"2(?: 0)?", "gpl-2.0", 3),
    ("gnu", r"gnu general public licen[sc]e" + _V + r"3(?: 0)?", "gpl-3.0", 3),
    ("gnu", r"gnu general public licen[sc]e(?: gpl)? v(?:ersion)? ?2(?: 0)? or (?:at your option )?(?:any )?later(?: version)?", "gpl-2.0-or-later", 3),
    ("gnu", r"gnu general public licen[sc]e(?: gpl)? v(?:ersion)? ?3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?", "gpl-3.0-or-later", 3),
    ("gnu", r"gnu gpl" + _V + r"2(?: 0)?", "gpl-2.0", 3),
    ("gnu", r"gnu gpl" + _V + r"3(?: 0)?", "gpl-3.0", 3),
    ("gnu", r"gnu gpl", "gpl", 1),
    ("gnu", r"under the terms of the gnu general public licen[sc]e", "gpl", 2),
    ("gnu", r"gnu lesser general public licen[sc]e" + _V + r"2 1", "lgpl-2.1", 3),
    ("gnu", r"gnu lesser general public licen[sc]e" + _V + r"3(?: 0)?", "lgpl-3.0", 3),
    ("gnu", r"gnu lesser general public licen[sc]e", "lgpl", 1),
    ("gnu", r"gnu library general public licen[sc]e" + _V + r"2(?: 0)?", "lgpl-2.0", 3),
    ("gnu", r"gnu library general public licen[sc]e", "lgpl", 1),
    ("gnu", r"gnu affero general public licen[sc]e" + _V + r"3(?: 0)?", "agpl-3.0", 3),
    ("gnu", r"gnu affero general public licen[sc]e", "agpl", 1),
    ("gnu", r"gnu free documentation licen[sc]e" + _V + r"1 [1-3]", "gfdl", 3),
    ("gnu", r"gnu free documentation licen[sc]e", "gfdl", 1),
    ("affero", r"affero general public licen[sc]e" + _V + r"1(?: 0)?", "agpl-1.0", 3),
    ("gplv2", r"gplv2(?: 0)?(?: only)?", "gpl-2.0", 2),
    ("gplv2", r"gplv2 or later", "gpl-2.0-or-later", 3),
    ("gplv3", r"gplv3(?: 0)?(?: only)?", "gpl-3.0", 2),
    ("gplv3", r"gplv3 or later", "gpl-3.0-or-later", 3),
    ("gpl", r"gpl 1 0 only", "gpl-1.0", 2),
    ("gpl", r"gpl 2 0(?: only)?", "gpl-2.0", 2),
    ("gpl", r"gpl 2 0 or later", "gpl-2.0-or-later", 3),
    ("gpl", r"gpl 3 0(?: only)?", "gpl-3.0", 2),
    ("gpl", r"gpl 3 0 or later", "gpl-3.0-or-later", 3),
    ("gpl", r"gpl compatible", "gpl-compatible", 0),
    ("lgpl", r"lgpl 2 0(?: only)?", "lgpl-2.0", 2),
    ("lgpl", r"lgpl 2 1(?: only)?", "lgpl-2.1", 2),
    ("lgpl", r"lgpl 2 1 or later", "lgpl-2.1-or-later", 3),
    ("lgpl", r"lgpl 3 0(?: only)?", "lgpl-3.0", 2),
    ("lgpl", r"lgpl 3 0 or later", "lgpl-3.0-or-later", 3),
    ("lgplv2", r"lgplv2(?: 1)?(?: or later)?", "lgpl-2.1", 2),
    ("lgplv3", r"lgplv3(?: or later)?", "lgpl-3.0", 2),
    ("agpl", r"agpl 3 0(?: only)?", "agpl-3.0", 2),
    ("agpl", r"agpl 3 0 or later", "agpl-3.0-or-later", 3),
    ("agplv3", r"agplv3(?: or later)?", "agpl-3.0", 2),
    ("gfdl", r"gfdl(?: 1 [1-3])?", "gfdl", 1),
    ("software", r"this program is free software you can redistribute it and or modify it", "gpl", 2),
    ("software", r"this library is free software you can redistribute it and or modify it", "lgpl", 2),
    ("foundation", r"published by the free software foundation", "fsf", 1),
    ("classpath", r"gnu classpath exception|classpath exception", "classpath-exception", 2),
    ("copyleft", r"(?:strong |weak )?copyleft(?: licen[sc]e)?", "copyleft", 0),
    # Apache
    ("apache", r"apache licen[sc]e" + _V + r"1 0", "apache-1.0", 3),
    ("apache", r"apache licen[sc]e" + _V + r"1 1", "apache-1.1", 3),
    ("apache", r"apache licen[sc]e" + _V + r"2(?: 0)?", "apache-2.0", 3),
    ("apache", r"licen[sc]ed under the apache licen[sc]e" + _V + r"2(?: 0)?(?: the licen[sc]e)?", "apache-2.0", 3),
    ("apache", r"apache software licen[sc]e" + _V + r"1 1", "apache-1.1", 3),
    ("apache", r"apache software licen[sc]e", "apache", 1),
    ("apache", r"apache 2(?: 0)?(?: licen[sc]ed?)?", "apache-2.0", 2),
    ("apache", r"apache org licenses license 2 0", "apache-2.0", 3),
    ("apache", r"apache foundation licen[sc]e", "apache", 1),
    ("asl", r"asl 2(?: 0)?", "apache-2.0", 1),
    ("compliance", r"you may not use this file except in compliance with the licen[sc]e", "apache-notice", 2),
    # MIT and its kin
    ("license licence licensed licenced", r"the mit licen[sc]e mit", "mit", 3),
    ("license licence licensed licenced", r"(?:released|licen[sc]ed|distributed|available) under (?:the )?(?:terms of the )?mit licen[sc]e", "mit", 3),
    ("license licence licensed licenced", r"mit licensed", "mit", 2),
    ("x11", r"mit x11 licen[sc]e", "x11", 2),
    ("license licence licensed licenced", r"mit style licen[sc]e", "mit-style", 2),
    ("attribution", r"mit no attribution", "mit-0", 3),
    ("opensource", r"opensource org licenses mit(?: license)?(?: php)?", "mit", 3),
    ("x11", r"x11 licen[sc]e", "x11", 2),
    ("expat", r"expat licen[sc]e", "mit", 2),
    ("hereby", r"permission is hereby granted free of charge to any person obtaining a copy", "mit", 2),
    ("copyright", r"the above copyright notice and this permission notice shall be included", "mit", 2),
    ("isc", r"isc licen[sc]e", "isc", 2),
    ("isc", r"internet systems consortium isc", "isc", 1),
    ("permission", r"permission to use copy modify and or distribute this software", "isc", 2),
    ("ncsa", r"(?:university of illinois )?ncsa open source licen[sc]e", "ncsa", 2),
    ("zlib", r"zlib licen[sc]e", "zlib", 2),
    ("zlib", r"zlib libpng licen[sc]e", "zlib", 2),
    ("boost", r"boost software licen[sc]e(?: version)?(?: 1 0)?", "bsl-1.0", 3),
    ("curl", r"curl licen[sc]e", "curl", 2),
    ("postgresql", r"postgresql licen[sc]e", "postgresql", 2),
    ("python", r"python software foundation licen[sc]e(?: version)?(?: 2(?: 0)?)?", "psf-2.0", 3),
    ("psf", r"psf licen[sc]e", "psf-2.0", 2),
    ("openssl", r"openssl licen[sc]e", "openssl", 2),
    ("php", r"php licen[sc]e" + _V + r"3 0?1?", "php-3.0", 3),
    ("php", r"php licen[sc]e", "php", 1),
    ("ruby", r"ruby licen[sc]e", "ruby", 1),
    ("perl", r"same terms as perl(?: itself)?", "perl", 2),
    ("artistic", r"artistic licen[sc]e" + _V + r"1(?: 0)?", "artistic-1.0", 3),
    ("artistic", r"artistic licen[sc]e" + _V + r"2(?: 0)?", "artistic-2.0", 3),
    ("artistic", r"artistic licen[sc]e", "artistic", 1),
    ("w3c", r"w3c software (?:notice and )?licen[sc]e", "w3c", 2),
    ("w3c", r"w3c document licen[sc]e", "w3c-document", 2),
    ("unicode", r"unicode licen[sc]e(?: agreement)?", "unicode", 2),
    ("vim", r"vim licen[sc]e", "vim", 2),
    ("freetype", r"freetype (?:project )?licen[sc]e", "ftl", 2),
    ("json", r"json licen[sc]e", "json", 2),
    ("evil", r"the software shall be used for good not evil", "json", 3),
    ("beerware", r"beerware licen[sc]e", "beerware", 2),
    ("beer", r"the beer ware licen[sc]e", "beerware", 2),
    ("wtfpl", r"wtfpl(?: 2)?", "wtfpl", 2),
    ("fuck", r"do what the fuck you want to public licen[sc]e", "wtfpl", 3),
    ("unlicense", r"(?:the )?unlicense", "unlicense", 2),
    ("unencumbered", r"this is free and unencumbered software released into the public domain", "unlicense", 3),
    ("0bsd", r"0bsd", "0bsd", 2),
    ("bsd", r"zero clause bsd(?: licen[sc]e)?", "0bsd", 3),
    ("oak", r"blue oak model licen[sc]e(?: 1 0 0)?", "blueoak-1.0", 3),
    ("permissive", r"universal permissive licen[sc]e(?: v1 0)?", "upl-1.0", 3),
    ("academic", r"academic free licen[sc]e" + _V + r"(?:[123] [0-2])?", "afl", 2),
    # BSD
    ("bsd", r"bsd licen[sc]e", "bsd", 1),
    ("bsd", r"bsd style licen[sc]e", "bsd-style", 1),
    ("bsd", r"(?:simplified|freebsd) bsd licen[sc]e", "bsd-2-clause", 2),
    ("bsd", r"(?:new|modified|revised) bsd licen[sc]e", "bsd-3-clause", 2),
    ("bsd", r"(?:original|old) bsd licen[sc]e", "bsd-4-clause", 2),
    ("bsd", r"bsd 2 clause(?: licen[sc]e)?", "bsd-2-clause", 3),
    ("bsd", r"bsd 3 clause(?: licen[sc]e)?", "bsd-3-clause", 3),
    ("bsd", r"bsd 4 clause(?: licen[sc]e)?", "bsd-4-clause", 3),
    ("bsd", r"(?:2|two) clause bsd(?: licen[sc]e)?", "bsd-2-clause", 3),
    ("bsd", r"(?:3|three) clause bsd(?: licen[sc]e)?", "bsd-3-clause", 3),
    ("bsd", r"(?:4|four) clause bsd(?: licen[sc]e)?", "bsd-4-clause", 3),
    ("bsd", r"bsd protection licen[sc]e", "bsd-protection", 3),
    ("freebsd", r"freebsd licen[sc]e", "bsd-2-clause", 2),
    ("redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", "bsd", 2),
    ("redistributions", r"redistributions of source code must retain the above copyright notice", "bsd", 2),
    ("redistributions", r"redistributions in binary form must reproduce the above copyright notice", "bsd", 2),
    ("endorse", r"neither the name of .{1,120}? may be used to endorse or promote", "bsd-3-clause", 2),
    ("advertising", r"all advertising materials mentioning features", "bsd-4-clause", 2),
    # Creative Commons
    ("cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0-1.0", 3),
    ("cc", r"cc by 1 0", "cc-by-1.0", 3),
    ("cc", r"cc by 2 0", "cc-by-2.0", 3),
    ("cc", r"cc by 2 5", "cc-by-2.5", 3),
    ("cc", r"cc by 3 0", "cc-by-3.0", 3),
    ("cc", r"cc by 4 0", "cc-by-4.0", 3),
    ("cc", r"cc by sa", "cc-by-sa", 2),
    ("cc", r"cc by sa 2 0", "cc-by-sa-2.0", 3),
    ("cc", r"cc by sa 2 5", "cc-by-sa-2.5", 3),
    ("cc", r"cc by sa 3 0", "cc-by-sa-3.0", 3),
    ("cc", r"cc by sa 4 0", "cc-by-sa-4.0", 3),
    ("cc", r"cc by nc", "cc-by-nc", 2),
    ("cc", r"cc by nc 2 0", "cc-by-nc-2.0", 3),
    ("cc", r"cc by nc 3 0", "cc-by-nc-3.0", 3),
    ("cc", r"cc by nc 4 0", "cc-by-nc-4.0", 3),
    ("cc", r"cc by nd", "cc-by-nd", 2),
    ("cc", r"cc by nd 3 0", "cc-by-nd-3.0", 3),
    ("cc", r"cc by nd 4 0", "cc-by-nd-4.0", 3),
    ("cc", r"cc by nc sa", "cc-by-nc-sa", 2),
    ("cc", r"cc by nc sa 3 0", "cc-by-nc-sa-3.0", 3),
    ("cc", r"cc by nc sa 4 0", "cc-by-nc-sa-4.0", 3),
    ("cc", r"cc by nc nd", "cc-by-nc-nd", 2),
    ("cc", r"cc by nc nd 3 0", "cc-by-nc-nd-3.0", 3),
    ("cc", r"cc by nc nd 4 0", "cc-by-nc-nd-4.0", 3),
    ("commons", r"creative commons attribution(?: licen[sc]e)?", "cc-by", 1),
    ("commons", r"creative commons attribution 2 0(?: generic)?", "cc-by-2.0", 3),
    ("commons", r"creative commons attribution 3 0(?: unported)?", "cc-by-3.0", 3),
    ("commons", r"creative commons attribution 4 0(?: international)?", "cc-by-4.0", 3),
    ("commons", r"creative commons attribution share ?alike", "cc-by-sa", 2),
    ("commons", r"creative commons attribution share ?alike 3 0(?: unported)?", "cc-by-sa-3.0", 3),
    ("commons", r"creative commons attribution share ?alike 4 0(?: international)?", "cc-by-sa-4.0", 3),
    ("commons", r"creative commons attribution non ?commercial", "cc-by-nc", 2),
    ("commons", r"creative commons attribution non ?commercial 4 0(?: international)?", "cc-by-nc-4.0", 3),
    ("commons", r"creative commons attribution non ?commercial share ?alike", "cc-by-nc-sa", 2),
    ("commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s", "cc-by-nc-nd", 2),
    ("commons", r"creative commons attribution no ?deriv(?:ative)?s", "cc-by-nd", 2),
    ("commons", r"creative commons zero", "cc0-1.0", 2),
    ("commons", r"creative commons public domain dedication", "cc0-1.0", 2),
    ("commons", r"creative commons licen[sc]e", "creative-commons", 0),
    ("creativecommons", r"creativecommons org licenses by [1-4] [05]", "cc-by", 3),
    ("creativecommons", r"creativecommons org licenses by sa [1-4] [05]", "cc-by-sa", 3),
    ("creativecommons", r"creativecommons org licenses by nc [1-4] [05]", "cc-by-nc", 3),
    ("creativecommons", r"creativecommons org licenses by nd [1-4] [05]", "cc-by-nd", 3),
    ("creativecommons", r"creativecommons org licenses by nc sa [1-4] [05]", "cc-by-nc-sa", 3),
    ("creativecommons", r"creativecommons org licenses by nc nd [1-4] [05]", "cc-by-nc-nd", 3),
    ("creativecommons", r"creativecommons org publicdomain zero 1 0", "cc0-1.0", 3),
    ("domain", r"public domain mark(?: 1 0)?", "public-domain", 2),
    ("domain", r"(?:released|dedicated|placed) (?:in|into|to) the public domain", "public-domain", 2),
    ("domain", r"public domain dedication", "public-domain", 1),
    ("domain", r"in the public domain", "public-domain", 1),
    # Mozilla, Eclipse, Sun, IBM, European, Microsoft and other weak copyleft
    ("mozilla", r"mozilla public licen[sc]e" + _V + r"1 0", "mpl-1.0", 3),
    ("mozilla", r"mozilla public licen[sc]e" + _V + r"1 1", "mpl-1.1", 3),
    ("mozilla", r"mozilla public licen[sc]e" + _V + r"2(?: 0)?", "mpl-2.0", 3),
    ("mozilla", r"mozilla public licen[sc]e", "mpl", 1),
    ("mpl", r"mpl 1 1", "mpl-1.1", 2),
    ("mpl", r"mpl 2 0", "mpl-2.0", 2),
    ("mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e", "mpl-2.0", 3),
    ("netscape", r"netscape public licen[sc]e(?: v(?:ersion)?)?(?: 1 [01])?", "npl", 2),
    ("eclipse", r"eclipse public licen[sc]e" + _V + r"1(?: 0)?", "epl-1.0", 3),
    ("eclipse", r"eclipse public licen[sc]e" + _V + r"2(?: 0)?", "epl-2.0", 3),
    ("eclipse", r"eclipse public licen[sc]e", "epl", 1),
    ("eclipse", r"eclipse distribution licen[sc]e(?: v(?:ersion)?)?(?: ?1 0)?", "edl-1.0", 2),
    ("epl", r"epl 1 0", "epl-1.0", 2),
    ("epl", r"epl 2 0", "epl-2.0", 2),
    ("development", r"common development and distribution licen[sc]e(?: v(?:ersion)?)?(?: ?1 [01])?", "cddl", 3),
    ("cddl", r"cddl 1 0", "cddl-1.0", 2),
    ("cddl", r"cddl 1 1", "cddl-1.1", 2),
    ("common", r"common public licen[sc]e(?: v(?:ersion)?)?(?: ?1 0)?", "cpl-1.0", 2),
    ("ibm", r"ibm public licen[sc]e(?: v(?:ersion)?)?(?: ?1 0)?", "ipl-1.0", 2),
    ("european", r"european union public licen[sc]e(?: v(?:ersion)?)?(?: ?1 [12])?", "eupl", 3),
    ("eupl eupl1", r"eupl(?: v)?(?: ?1 [12])?", "eupl", 2),
    ("cecill", r"cecill(?: [bc])?(?: licen[sc]e)?", "cecill", 2),
    ("microsoft", r"microsoft public licen[sc]e", "ms-pl", 3),
    ("microsoft", r"microsoft reciprocal licen[sc]e", "ms-rl", 3),
    ("sil", r"sil open font licen[sc]e(?: v(?:ersion)?)?(?: ?1 1)?", "ofl-1.1", 3),
    ("font", r"open font licen[sc]e", "ofl", 1),
    ("ofl", r"ofl 1 1", "ofl-1.1", 2),
    ("database", r"open database licen[sc]e", "odbl-1.0", 3),
    ("odbl", r"odbl(?: 1 0)?", "odbl-1.0", 2),
    ("commons", r"open data commons attribution licen[sc]e", "odc-by-1.0", 3),
    ("commons", r"open data commons public domain dedication", "pddl-1.0", 3),
    ("community", r"community data licen[sc]e agreement permissive", "cdla-permissive", 3),
    ("community", r"community data licen[sc]e agreement sharing", "cdla-sharing", 3),
    ("government", r"open government licen[sc]e(?: v(?:ersion)?)?(?: ?[123](?: 0)?)?", "ogl-uk", 2),
    ("software", r"open software licen[sc]e(?: v(?:ersion)?)?(?: ?[123] 0)?", "osl", 2),
    ("license licence", r"q public licen[sc]e", "qpl", 2),
    ("sleepycat", r"sleepycat licen[sc]e", "sleepycat", 2),
    ("latex", r"latex project public licen[sc]e", "lppl", 2),
    ("server", r"server side public licen[sc]e(?: v(?:ersion)?)?(?: ?1)?", "sspl-1.0", 3),
    ("business", r"business source licen[sc]e(?: 1 1)?", "busl-1.1", 3),
    ("elastic", r"elastic licen[sc]e(?: 2 0)?", "elastic-2.0", 3),
    ("commons", r"commons clause(?: licen[sc]e condition)?", "commons-clause", 2),
    ("polyform", r"polyform (?:noncommercial|small business|shield|strict|internal use) licen[sc]e", "polyform", 3),
    ("mulan", r"mulan (?:permissive|psl)(?: software licen[sc]e)?(?: v(?:ersion)?)?(?: ?2)?", "mulanpsl-2.0", 2),
    ("openrail rail", r"(?:bigscience |creativeml )?open ?rail(?: m)?(?: licen[sc]e)?", "openrail", 2),
    # SPDX tags
    ("spdx", _SPDX + r"mit", "mit", 3),
    ("spdx", _SPDX + r"apache 2 0", "apache-2.0", 3),
    ("spdx", _SPDX + r"gpl 2 0(?: only)?", "gpl-2.0", 3),
    ("spdx", _SPDX + r"gpl 2 0 or later", "gpl-2.0-or-later", 3),
    ("spdx", _SPDX + r"gpl 3 0(?: only)?", "gpl-3.0", 3),
    ("spdx", _SPDX + r"gpl 3 0 or later", "gpl-3.0-or-later", 3),
    ("spdx", _SPDX + r"lgpl 2 1(?: only)?(?: or later)?", "lgpl-2.1", 3),
    ("spdx", _SPDX + r"lgpl 3 0(?: only)?(?: or later)?", "lgpl-3.0", 3),
    ("spdx", _SPDX + r"agpl 3 0(?: only)?(?: or later)?", "agpl-3.0", 3),
    ("spdx", _SPDX + r"bsd 2 clause", "bsd-2-clause", 3),
    ("spdx", _SPDX + r"bsd 3 clause", "bsd-3-clause", 3),
    ("spdx", _SPDX + r"mpl 2 0", "mpl-2.0", 3),
    ("spdx", _SPDX + r"epl 2 0", "epl-2.0", 3),
    ("spdx", _SPDX + r"isc", "isc", 3),
    ("spdx", _SPDX + r"cc0 1 0", "cc0-1.0", 3),
    ("spdx", _SPDX + r"cc by 4 0", "cc-by-4.0", 3),
    ("spdx", _SPDX + r"cc by sa 4 0", "cc-by-sa-4.0", 3),
    ("spdx", _SPDX + r"unlicense", "unlicense", 3),
    # Notices without a named licence
    ("reserved", r"all rights reserved", "all-rights-reserved", 1),
    ("proprietary", r"proprietary and confidential", "proprietary", 2),
    ("proprietary", r"proprietary licen[sc]e", "proprietary", 2),
    ("commercial", r"commercial licen[sc]e", "commercial", 1),
    ("agreement", r"end user licen[sc]e agreement", "eula", 2),
    ("dual", r"dual licen[sc]ed", "dual-licensed", 1),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", "copyright-notice", 0),
    ("warranty warranties", r"(?:provided )?as is without warrant(?:y|ies) of any kind", "no-warranty", 1),
    ("commercial", r"non commercial use only", "non-commercial", 2),
    ("noncommercial", r"noncommercial use only", "non-commercial", 2),
]
