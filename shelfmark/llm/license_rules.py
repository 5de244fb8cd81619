"""The signature rules of the license scan, in order of priority.

A rule is (label, kind, keyword, pattern) over normalised words: lower-case words with one blank
between them. ``kind`` is the priority class; a detection inside one of a stronger class is
suppressed. The keyword must occur in a text for the pattern to be tried, so it is a part of
whatever the pattern matches. ``cues`` are whole words of which such a text has one; without them,
the keyword's longest word is one. Patterns use only
what Java's and RE2's regular expressions share, and match whole words.
"""

from __future__ import annotations

from dataclasses import dataclass

# Priority classes, strongest first.
SENTENCE, TAG, TITLE, LINK, BASE, HINT = range(6)


@dataclass(frozen=True)
class Rule:
    label: str
    kind: int
    keyword: str
    pattern: str
    cues: tuple[str, ...] = ()


# Phrases and labels whose places every scan must report (fixed values).
BASE_RULES = (
    Rule("gpl", BASE, "gnu general public license", "gnu general public license"),
    Rule("apache", BASE, "apache license", "apache license"),
    Rule("cc-by", BASE, "cc by", "cc by"),
    Rule("mit", BASE, "mit license", "mit license"),
)

# Sentences that licences and their notices are made of: label, keyword, pattern.
SENTENCES = (
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "without restriction", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute( sublicense and or sell)?"),
    ("mit", "substantial portions", "the above copyright notice and this permission notice( including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "binary form must reproduce", "redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd-3-clause", "endorse or promote", "neither the name of [0-9a-z ]{1,80} may be used to endorse or promote products derived from"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "apache license", "licensed under the apache license version 2( 0)?"),
    ("apache-2.0", "compliance with the license", "you may not use this file except in compliance with the license"),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation"),
    ("gpl-3.0", "general public license", "gnu general public license( as published by the free software foundation)? (either )?version 3"),
    ("gpl-2.0", "general public license", "gnu general public license( as published by the free software foundation)? (either )?version 2"),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "general public license", "under the terms of the gnu (lesser|library) general public license"),
    ("agpl-3.0", "affero", "gnu affero general public license( as published by the free software foundation)? (either )?version 3"),
    ("gfdl", "free documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "mozilla public", "subject to the terms of the mozilla public license v(ersion)?( )?2( 0)?"),
    ("mpl-1.1", "mozilla public", "subject to the mozilla public license version 1 1"),
    ("isc", "with or without fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "what the fuck", "you just do what the fuck you want to"),
    ("bsl-1.0", "boost software", "distributed under the boost software license version 1 0"),
    ("epl-2.0", "eclipse public", "made available under the terms of the eclipse public license (v|version )?2( 0)?"),
    ("epl-1.0", "eclipse public", "made available under the terms of the eclipse public license (v|version )?1( 0)?"),
    ("cddl", "common development", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cc0-1.0", "dedicated the work", "has dedicated the work to the public domain by waiving all of (his|her|their|his or her) rights"),
    ("cc-by", "creative commons", "licensed under a creative commons attribution [1-4]( 0| 5)? (international|unported|generic)"),
    ("cc-by-sa", "creative commons", "licensed under a creative commons attribution share( )?alike [1-4]( 0| 5)?"),
    ("cc-by-nc", "creative commons", "licensed under a creative commons attribution non( )?commercial [1-4]( 0| 5)?"),
    ("ofl-1.1", "sil open font", "this font software is licensed under the sil open font license"),
    ("artistic-2.0", "artistic license", "under the terms of the artistic license( version)? 2( 0)?"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("proprietary", "strictly prohibited", "(reproduction|distribution|copying|use)( or [a-z]{1,20})?( of this [a-z]{1,20})? is strictly prohibited"),
    ("proprietary", "confidential", "confidential and proprietary"),
    ("warranty-disclaimer", "as is", "provided (by [0-9a-z ]{1,80} )?as is without warranty of any kind"),
    ("warranty-disclaimer", "without any warranty", "but without any warranty without even the implied warranty of merchantability"),
)

# Licences with a name, an SPDX-like identifier and an address: label, name, versions, host word.
FAMILIES = (
    ("gpl", "gnu general public license", ("1", "2", "3"), "gnu org licenses gpl"),
    ("lgpl", "gnu lesser general public license", ("2", "2 1", "3"), "gnu org licenses lgpl"),
    ("agpl", "gnu affero general public license", ("1", "3"), "gnu org licenses agpl"),
    ("gfdl", "gnu free documentation license", ("1 1", "1 2", "1 3"), "gnu org licenses fdl"),
    ("apache", "apache license", ("1", "1 1", "2"), "apache org licenses"),
    ("mit", "mit license", (), "opensource org licenses mit"),
    ("mit-0", "mit no attribution", (), "opensource org licenses mit 0"),
    ("bsd", "bsd license", (), "opensource org licenses bsd"),
    ("bsd-2-clause", "bsd 2 clause", (), "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd 3 clause", (), "opensource org licenses bsd 3 clause"),
    ("isc", "isc license", (), "opensource org licenses isc"),
    ("zlib", "zlib license", (), "opensource org licenses zlib"),
    ("mpl", "mozilla public license", ("1", "1 1", "2"), "mozilla org mpl"),
    ("epl", "eclipse public license", ("1", "2"), "eclipse org legal epl"),
    ("cddl", "common development and distribution license", ("1", "1 1"), "opensource org licenses cddl"),
    ("cpl", "common public license", ("1",), "opensource org licenses cpl"),
    ("bsl", "boost software license", ("1",), "boost org license"),
    ("artistic", "artistic license", ("1", "2"), "opensource org licenses artistic"),
    ("afl", "academic free license", ("1 2", "2", "2 1", "3"), "opensource org licenses afl"),
    ("osl", "open software license", ("1", "2", "2 1", "3"), "opensource org licenses osl"),
    ("eupl", "european union public license", ("1", "1 1", "1 2"), "eupl eu"),
    ("cecill", "cecill license", ("1", "2", "2 1"), "cecill info"),
    ("ofl", "sil open font license", ("1", "1 1"), "scripts sil org ofl"),
    ("python", "python software foundation license", ("2",), "docs python org license"),
    ("php", "php license", ("3", "3 1"), "php net license"),
    ("ruby", "ruby license", (), "ruby lang org license"),
    ("openssl", "openssl license", (), "openssl org source license"),
    ("postgresql", "postgresql license", (), "postgresql org about licence"),
    ("unlicense", "the unlicense", (), "unlicense org"),
    ("wtfpl", "do what the fuck you want to public license", ("1", "2"), "wtfpl net"),
    ("cc0", "cc0 universal", ("1",), "creativecommons org publicdomain zero"),
    ("cc-by", "creative commons attribution", ("1", "2", "2 5", "3", "4"), "creativecommons org licenses by"),
    ("cc-by-sa", "creative commons attribution sharealike", ("1", "2", "2 5", "3", "4"), "creativecommons org licenses by sa"),
    ("cc-by-nc", "creative commons attribution noncommercial", ("1", "2", "2 5", "3", "4"), "creativecommons org licenses by nc"),
    ("cc-by-nd", "creative commons attribution noderivatives", ("1", "2", "2 5", "3", "4"), "creativecommons org licenses by nd"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike", ("1", "2", "2 5", "3", "4"), "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives", ("1", "2", "2 5", "3", "4"), "creativecommons org licenses by nc nd"),
    ("odbl", "open database license", ("1",), "opendatacommons org licenses odbl"),
    ("pddl", "public domain dedication and license", ("1",), "opendatacommons org licenses pddl"),
    ("odc-by", "open data commons attribution license", ("1",), "opendatacommons org licenses by"),
    ("upl", "universal permissive license", ("1",), "oss oracle com licenses upl"),
    ("ms-pl", "microsoft public license", (), "opensource org licenses ms pl"),
    ("ms-rl", "microsoft reciprocal license", (), "opensource org licenses ms rl"),
    ("ncsa", "university of illinois ncsa open source license", (), "opensource org licenses ncsa"),
    ("vim", "vim license", (), "vimdoc sourceforge net"),
    ("x11", "x11 license", (), "xfree86 org license"),
    ("zpl", "zope public license", ("1 1", "2", "2 1"), "opensource org licenses zpl"),
    ("sspl", "server side public license", ("1",), "mongodb com licensing server side public license"),
    ("elastic", "elastic license", ("2",), "elastic co licensing"),
    ("busl", "business source license", ("1 1",), "mariadb com bsl"),
    ("openrail", "open rail m license", (), "huggingface co spaces bigscience license"),
    ("llama", "llama community license", ("2", "3", "3 1"), "ai meta com llama license"),
)

# Weak hints, reported only where nothing stronger covers them: label, keyword, pattern, and cues
# where the keyword's words are beginnings of words.
HINTS = (
    ("mit", "mit licence", "mit licence"),
    ("mit", "mit licensed", "mit licensed"),
    ("apache", "apache 2", "apache 2( 0)?"),
    ("apache", "asl 2", "asl 2( 0)?"),
    ("gpl", "gplv", "gplv[123]( or later)?", ("gplv1", "gplv2", "gplv3")),
    ("lgpl", "lgplv", "lgplv[23]( 1)?( or later)?", ("lgplv2", "lgplv3")),
    ("agpl", "agplv", "agplv3( or later)?", ("agplv3",)),
    ("gpl", "copyleft", "copyleft license"),
    ("gpl", "gnu gpl", "gnu gpl"),
    ("bsd", "bsd style", "bsd style( license)?"),
    ("bsd", "bsd licensed", "bsd licensed"),
    ("bsd", "simplified bsd", "simplified bsd( license)?"),
    ("bsd", "bsd", "(new|modified|revised) bsd( license)?"),
    ("cc-by", "creative commons", "creative commons licen[cs]e"),
    ("public-domain", "public domain", "(in|into|to) the public domain"),
    ("open-source", "open source", "open source (software )?licen[cs]e"),
    ("proprietary", "proprietary licen", "proprietary licen[cs]e"),
    ("proprietary", "copyright", "copyright( c)? (19|20)[0-9][0-9]"),
)


def _family_rules() -> list[Rule]:
    """Three kinds of rules for each family: tagged identifier, title with version, address."""
    rules = []
    for label, name, versions, host in FAMILIES:
        spdx = label.replace("-", " ")
        numbers = "|".join(f"{v}( 0)?" for v in sorted(versions, key=len, reverse=True))
        rules.append(Rule(
            label, TAG, "spdx license identifier",
            f"spdx license identifier {spdx}" + (f"( ({numbers}))?( only| or later)?" if versions else ""),
        ))
        if versions:
            rules.append(Rule(label, TITLE, name, f"{name} (v|version |v )?({numbers})( or later| or newer)?"))
        if label not in {r.label for r in BASE_RULES} or name not in {r.pattern for r in BASE_RULES}:
            rules.append(Rule(label, TITLE, name, name))
        rules.append(Rule(label, LINK, host, host))
    return rules


def all_rules() -> list[Rule]:
    """Every rule, strongest class first; the place in the list is the rule's number."""
    rules = [Rule(label, SENTENCE, k, p) for label, k, p in SENTENCES]
    rules += _family_rules()
    rules += BASE_RULES
    rules += [Rule(label, HINT, *rest) for label, *rest in HINTS]
    return sorted(rules, key=lambda r: r.kind)


def spaced(pattern: str) -> str:
    """``pattern`` for texts in which each word has a blank of its own on either side.

    So neighbouring matches never share a blank, and no look-around is needed. A blank
    inside a bracket expression stays one blank. A blank that may be missing is ``( )?``.
    """
    out, in_set = [], False
    for c in f" {pattern} ":
        in_set = c == "[" or (in_set and c != "]")
        out.append(c if c != " " or in_set else "  ")
    doubled = "".join(out)
    return doubled[1:-1]
