"""Licence wordings to look for."""

# Names as notices write them.
NAMES = {
    "MIT": "MIT License",
    "Apache-2.0": "Apache License, Version 2.0",
    "GPL-2.0": "GNU General Public License, version 2",
    "GPL-3.0": "GNU General Public License, version 3",
    "LGPL-2.1": "GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "AGPL-3.0": "GNU Affero General Public License, version 3",
    "MPL-2.0": "Mozilla Public License, version 2.0",
    "EPL-2.0": "Eclipse Public License, version 2.0",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "ISC": "ISC License",
    "BSL-1.0": "Boost Software License, Version 1.0",
    "Artistic-2.0": "Artistic License 2.0",
    "CC0-1.0": "CC0 1.0",
    "CC-BY-4.0": "CC BY 4.0",
    "CC-BY-SA-4.0": "CC BY-SA 4.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0",
    "CC-BY-ND-4.0": "CC BY-ND 4.0",
    "CC-BY-NC-SA-4.0": "CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0": "CC BY-NC-ND 4.0",
}

# Families of names and the versions that stand behind them, as notices also write them. A name of one
# word without a digit is looked for in fewer places, since it is a common word elsewhere.
_GPL = (["GNU General Public License", "GNU GPL", "GPL"], "GPL")
_LGPL = (["GNU Lesser General Public License", "Lesser General Public License", "GNU LGPL", "LGPL"], "LGPL")
_AGPL = (["GNU Affero General Public License", "Affero General Public License", "GNU AGPL", "AGPL"], "AGPL")
_VERSIONED = {
    "Apache-2.0": (["Apache License", "Apache Software License", "Apache Public License", "Apache"], None, ["2.0", "2"]),
    "GPL-2.0": (*_GPL, ["2", "2.0"]),
    "GPL-3.0": (*_GPL, ["3", "3.0"]),
    "LGPL-2.1": (*_LGPL, ["2.1"]),
    "LGPL-3.0": (*_LGPL, ["3", "3.0"]),
    "AGPL-3.0": (*_AGPL, ["3", "3.0"]),
    "MPL-2.0": (["Mozilla Public License", "MPL"], "MPL", ["2.0", "2"]),
    "EPL-2.0": (["Eclipse Public License", "EPL"], "EPL", ["2.0", "2"]),
    "BSL-1.0": (["Boost Software License", "Boost License"], None, ["1.0", "1"]),
    "Artistic-2.0": (["Artistic License"], None, ["2.0", "2"]),
}
_CC = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
_OTHERS = {
    "MIT": ["MIT", "Expat License", "MIT/Expat License", "MIT/X11 License", "X11/MIT License"],
    "ISC": ["ISC"],
    "BSD-2-Clause": ["2-Clause BSD License", "BSD-2-Clause License", "BSD-2-Clause", "BSD 2-Clause", "2-Clause BSD", "BSD 2 Clause", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["3-Clause BSD License", "BSD-3-Clause License", "BSD-3-Clause", "BSD 3-Clause", "3-Clause BSD", "BSD 3 Clause", "New BSD License", "Modified BSD License", "Revised BSD License"],
    "CC0-1.0": ["CC0-1.0", "CC0", "CC0 1.0 Universal", "CC0 Version 1.0", "Creative Commons Zero 1.0", "Creative Commons Zero v1.0", "Creative Commons Zero", "Creative Commons CC0 1.0", "Creative Commons CC0"],
}


def _spellings() -> dict[str, list[str]]:
    out = {name: [raw] for name, raw in NAMES.items()}
    for name, (families, short, versions) in _VERSIONED.items():
        for family in families:
            out[name] += [f"{family} {x}{v}" for v in versions for x in ("version ", "v", "v ", "ver ", "") if " " in family or len(v) > 1 or x or short]
        for v in versions if short else []:
            out[name] += [f"{short}v{v}", f"{short}-v{v}", f"{short}{v}", f"{short}-{v}", f"{short}-{v}-only", f"{short}-{v}-or-later"]
        out[name] += [name, f"{name} License", f"{name}-only", f"{name}-or-later"]
    for name, others in _OTHERS.items():
        out[name] += others
    for name in NAMES:
        if name.startswith("CC-BY"):
            parts = name.split("-")[1:-1]
            short, long = "-".join(parts), [_CC[p] for p in parts]
            out[name] += [name, f"CC-{short} 4.0", f"CC {short}-4.0", f"CC {' '.join(parts)} 4.0", f"Creative Commons {short} 4.0", f"Creative Commons {'-'.join(long)} 4.0", f"Creative Commons {' '.join(long)} 4.0"]
            out[name] += [f"{x} International" for x in out[name][1:]]
    return {name: list(dict.fromkeys(x)) for name, x in out.items()}


SPELLINGS = _spellings()

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS"'
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."""

# Texts that stand in files as a whole.
TEXTS = {
    "MIT": f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "ISC": f"""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
{_AS_IS} AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "BSD-2-Clause": _BSD,
    "BSD-3-Clause": _BSD
    + """
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-2.0": _GNU.format(kind="", n="2"),
    "GPL-3.0": _GNU.format(kind="", n="3"),
    "LGPL-3.0": _GNU.format(kind="Lesser ", n="3"),
    "AGPL-3.0": _GNU.format(kind="Affero ", n="3"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
}
