"""License notices to look for: whole short licences, and the notices that their stewards publish for longer ones.

``-grant`` and ``-conditions`` are the opening parts, for files that leave out the disclaimer. The full texts of Apache,
GNU, Mozilla and Creative Commons licences are not here; they can be given as a parameter.
"""

from __future__ import annotations

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so")
_MIT_CONDITION = (
    ", subject to the following conditions: The above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the Software")
_MIT_WARRANTY = (
    ". THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.")
_MIT_LIABILITY = (
    " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE.")
_ISC_USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = (
    " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE.")
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: {}Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. {}Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.")
_BSD_NAMES = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.")
_BSD_WARRANTY = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_GNU = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the "
    "Free Software Foundation, {choice}. This {what} is "
    "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.")


def _gnu(name: str, version: str, what: str = "program", later: bool = True) -> str:
    choice = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    return _GNU.format(name=f"GNU {name}General Public License", choice=choice, what=what)


_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

#: Identifiers of the SPDX list, as source files state them in one line.
SPDX = (
    "MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "Apache-2.0", "MPL-2.0", "Unlicense", "CC0-1.0",
    *(f"{k}-{end}" for k in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for end in ("only", "or-later")),
    *(f"CC-{k}-4.0" for k in _CC))

TEMPLATES = {
    **{f"SPDX-{k}": f"SPDX-License-Identifier: {k}" for k in SPDX},
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    **{f"{k}-notice": f"This work is licensed under the GNU {v} General Public License, version {k[-3:].removesuffix('.0')}."
       for k, v in (("LGPL-2.1", "Lesser"), ("LGPL-3.0", "Lesser"), ("AGPL-3.0", "Affero"))},
    **{f"CC-{k}-4.0-short": f"Licensed under CC {k} 4.0." for k in _CC if k != "BY-NC"},
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    **{f"CC-{k}-4.0-{'long' if k == 'BY-NC' else 'notice'}": f"This work is licensed under a Creative Commons {v} 4.0 International License."
       for k, v in _CC.items()},
    "MIT": _MIT_GRANT + _MIT_CONDITION + _MIT_WARRANTY + _MIT_LIABILITY,
    "MIT-grant": _MIT_GRANT + _MIT_CONDITION + _MIT_WARRANTY,
    "MIT-0": _MIT_GRANT + _MIT_WARRANTY + _MIT_LIABILITY,
    "ISC": _ISC_USE + _ISC_NOTICE + _ISC_WARRANTY,
    "ISC-grant": _ISC_USE + _ISC_NOTICE,
    "0BSD": _ISC_USE + "." + _ISC_WARRANTY,
    "BSD-conditions": _BSD_CONDITIONS.format("", ""),
    "BSD-2-Clause": _BSD_CONDITIONS.format("1. ", "2. ") + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD_CONDITIONS.format("1. ", "2. ") + _BSD_NAMES + _BSD_WARRANTY,
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated "
        "but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being "
        "the original software. 3. This notice may not be removed or altered from any source distribution."),
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."),
    "GPL-2.0-only": _gnu("", "2", later=False),
    "GPL-3.0-only": _gnu("", "3", later=False),
    "GPL-2.0-or-later": _gnu("", "2"),
    "GPL-3.0-or-later": _gnu("", "3"),
    "LGPL-2.1-or-later": _gnu("Lesser ", "2.1", "library"),
    "LGPL-3.0-or-later": _gnu("Lesser ", "3"),
    "AGPL-3.0-or-later": _gnu("Affero ", "3"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or "
        "authors of this software dedicate any and all copyright interest in the software to the public domain. We make this "
        "dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
        "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under "
        "copyright law." + _MIT_WARRANTY[1:] + _MIT_LIABILITY.replace("OR COPYRIGHT HOLDERS ", "")
        + " For more information, please refer to <https://unlicense.org/>"),
}
#: Words in a row that a match must hold: what tells versions and variants apart.
REQUIRED = {
    **{f"SPDX-{k}": [k] for k in SPDX},
    "GPL-2.0-only": ["GNU General", "version 2"],
    "GPL-3.0-only": ["GNU General", "version 3"],
    "MIT-notice": ["MIT"],
    "Apache-2.0-notice": ["Apache", "2.0"],
    "Apache-2.0": ["Apache", "2.0"],
    "BSL-1.0-notice": ["Boost", "1.0"],
    "MPL-2.0": ["2.0"],
    "GPL-2.0-notice": ["General", "version 2"],
    "GPL-3.0-notice": ["General", "version 3"],
    "LGPL-2.1-notice": ["Lesser General", "version 2.1"],
    "LGPL-3.0-notice": ["Lesser General", "version 3"],
    "AGPL-3.0-notice": ["Affero General", "version 3"],
    "GPL-2.0-or-later": ["GNU General", "version 2", "at your option"],
    "GPL-3.0-or-later": ["GNU General", "version 3", "at your option"],
    "LGPL-2.1-or-later": ["Lesser General", "version 2.1", "at your option"],
    "LGPL-3.0-or-later": ["Lesser General", "version 3", "at your option"],
    "AGPL-3.0-or-later": ["Affero General", "version 3", "at your option"],
    "BSD-3-Clause": ["endorse or promote"],
    **{name: [f"{v} 4.0" if name.startswith("CC") and "Commons" in TEMPLATES[name] else f"{k} 4.0"]
       for k, v in _CC.items() for name in TEMPLATES if name.startswith(f"CC-{k}-4.0-")},
}
