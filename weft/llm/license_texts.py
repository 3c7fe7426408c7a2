"""Licence notices and texts as templates of words.

A phrase in braces tells a licence from its kin: a chain without it, unbroken, is no find.
"""

from __future__ import annotations

_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
    "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal "
    "in the software without restriction"
)
_REDISTRIBUTE = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
    "and or other materials provided with the"
)
_HOLDERS = (
    "is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct "
    "indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data "
    "or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or "
    "otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_ISC_WARRANTY = (
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and "
    "fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of "
    "use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
_USE = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"


def _gnu(thing: str, name: str, version: str) -> str:
    return (
        f"{thing} is free software you can redistribute it and or modify it under the terms of the {{{name} as published}} by the free software foundation "
        f"either {{version {version} of the license}} or at your option any later version"
    )


def _gnus(label: str, name: str, version: str) -> list[tuple[str, str]]:
    return [(label, _gnu(thing, name, version)) for thing in ("this program", "this library")] + [(label, f"licensed under the {{{name} version {version}}}"), (label, f"licensed under the terms of the {{{name} version {version}}}")]


def _commons() -> list[tuple[str, str]]:
    parts = {"by": "attribution", "sa": "sharealike", "nd": "noderivatives", "nc": "noncommercial"}
    old = {"sa": "share alike", "nd": "noderivs"}
    found = []
    for kinds in (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd")):
        label, short = "cc-" + "-".join(kinds), "cc " + " ".join(kinds)
        for version, end in (("4 0", "international"), ("3 0", "unported")):
            for names in (parts, parts | old) if version == "3 0" and len(kinds) > 1 else (parts,):
                whole = " ".join(names[k] for k in kinds)
                found += [(label, f"this work is licensed under {word} {{creative commons {whole} {version}}} {end} license") for word in ("the", "a")]
            found.append((label, f"licensed under {{{short} {version}}}"))
    return found


TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "released under the mit license"),
    ("mit", _GRANT),
    ("mit", f"{_GRANT} including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software {_WARRANTY}"),
    ("apache-2", "licensed under the {apache license version 2 0}"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses {license 2 0}"),
    ("apache-2", "licensed under the {apache license version 2 0} the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2", "{apache license version 2 0 january 2004} http www apache org licenses terms and conditions for use reproduction and distribution"),
    ("gpl-3", "this work is licensed under the gnu general public {license version 3}"),
    ("gpl-2", "this work is licensed under the gnu general public {license version 2}"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the {gnu general public license version 2} as published by the free software foundation"),
    *_gnus("gpl-2", "gnu general public license", "2"),
    *_gnus("gpl-3", "gnu general public license", "3"),
    *_gnus("agpl-3", "gnu affero general public license", "3"),
    *_gnus("lgpl-2", "gnu library general public license", "2"),
    *_gnus("lgpl-2.1", "gnu lesser general public license", "2 1"),
    *_gnus("lgpl-3", "gnu lesser general public license", "3"),
    ("gpl-2", "{gnu general public license version 2 june 1991} copyright c 1989 1991 free software foundation inc"),
    ("gpl-3", "{gnu general public license version 3 29 june 2007} copyright c 2007 free software foundation inc"),
    ("agpl-3", "{gnu affero general public license version 3 19 november 2007} copyright c 2007 free software foundation inc"),
    ("lgpl-2.1", "{gnu lesser general public license version 2 1 february 1999} copyright c 1991 1999 free software foundation inc"),
    ("lgpl-3", "{gnu lesser general public license version 3 29 june 2007} copyright c 2007 free software foundation inc"),
    ("bsd-2-clause", f"{_REDISTRIBUTE} {{distribution this software is provided}} by"),
    ("bsd-3-clause", f"{_REDISTRIBUTE} distribution 3 {{neither the name of}} the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-2-clause", f"{_REDISTRIBUTE} {{distribution this software is provided}} {_HOLDERS.removeprefix('is provided ')}"),
    ("bsd-3-clause", f"{_REDISTRIBUTE} distribution 3 {{neither the name of}} the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software {_HOLDERS}"),
    ("isc", f"{_USE} {{granted provided that the above copyright notice and this permission notice appear in all copies}} {_ISC_WARRANTY}"),
    ("isc", f"{_USE} {{granted provided that the above copyright notice and this permission notice appear in all copies}}"),
    ("0bsd", f"{_USE} {{granted the software is provided as is}} {_ISC_WARRANTY.removeprefix('the software is provided as is ')}"),
    ("mpl-2", "this source code form is subject to the terms of the {mozilla public license v 2 0}"),
    ("mpl-2", "this source code form is subject to the terms of the {mozilla public license v 2 0} if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software {released into the public domain} anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    *[(label, f"{{spdx license identifier {name}}}") for label, name in (("mit", "mit"), ("apache-2", "apache 2 0"), ("gpl-2", "gpl 2 0"), ("gpl-3", "gpl 3 0"), ("agpl-3", "agpl 3 0"), ("lgpl-2.1", "lgpl 2 1"), ("lgpl-3", "lgpl 3 0"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"), ("isc", "isc"), ("mpl-2", "mpl 2 0"), ("unlicense", "unlicense"))],
    *_commons(),
)
