"""Licence texts for the licence scan. The words of public licences and of the notices that stand in files,
in their usual wording; "..." parts what differs from file to file, such as names and years.

A template has a label, its mandatory key phrases (all must stand at their places) and its text. The scan reads words
only, so case and punctuation say nothing."""

from __future__ import annotations

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software."""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THREE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License."""
_GNU_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} General Public
License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} General Public License for more details."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
Software, and to prepare derivative works of the Software"""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_CC0 = """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"""

#: Label, key phrases, text.
TEMPLATES: tuple[tuple[str, tuple[str, ...], str], ...] = (
    ("mit", ("the mit license",), "Released under the MIT License"),
    ("mit", ("permission is hereby granted free of charge to any person obtaining a copy of this software",), _MIT_GRANT),
    ("mit", ("without warranty of any kind express or implied",), _MIT_WARRANTY),
    ("bsd-2-clause", ("redistribution and use in source and binary forms", "in binary form must reproduce"), _BSD_TWO),
    ("bsd-3-clause", ("may be used to endorse or promote products",), _BSD_THREE),
    ("isc", ("permission to use copy modify and or distribute this software",), _ISC),
    ("apache-2.0", ("apache license version 2 0",), "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", ("apache license version 2 0", "agreed to in writing"), _APACHE),
    ("gpl-2.0", ("general public license version 2",), "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", ("general public license version 3",), "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", ("general public license as published", "either version 2"), _GNU_NOTICE.format("", "2")),
    ("gpl-3.0", ("general public license as published", "either version 3"), _GNU_NOTICE.format("", "3")),
    ("lgpl-2.1", ("lesser general public license", "either version 2 1"), _GNU_NOTICE.format("Lesser", "2.1")),
    ("lgpl-3.0", ("lesser general public license", "either version 3"), _GNU_NOTICE.format("Lesser", "3")),
    ("agpl-3.0", ("affero general public license", "either version 3"), _GNU_NOTICE.format("Affero", "3")),
    ("mpl-2.0", ("mozilla public license v 2 0",), _MPL),
    ("unlicense", ("free and unencumbered software",), _UNLICENSE),
    ("zlib", ("without any express or implied warranty",), _ZLIB),
    ("bsl-1.0", ("person or organization obtaining a copy",), _BOOST),
    ("cc-by-4.0", ("cc by 4 0",), "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", ("cc by sa 4 0",), "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", ("cc by nc 4 0",), "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd-4.0", ("cc by nd 4 0",), "Licensed under CC BY-ND 4.0"),
    ("cc0-1.0", ("cc0 1 0",), "Dedicated to the public domain under CC0 1.0"),
    ("cc0-1.0", ("waived all copyright and related or neighboring rights",), _CC0),
)
