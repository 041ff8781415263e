"""Licence forms as they stand in files, near misses, and a long text full of them."""

import time

from shelfscan.llm import licenses

FORMS = """GPL license|gpl
MIT-licensed|mit
License: MIT|mit
Licence: ISC|isc
"license": "MIT",|mit
license = "Apache-2.0"|apache-2.0
license='BSD-3-Clause'|bsd
license: GPL-3.0-or-later|gpl-3.0
<license>MPL-2.0</license>|mpl-2.0
# License: LGPLv2.1|lgpl-2.1
"license" : "ISC"|isc
license: cc0-1.0|cc0-1.0
"license": "Unlicense"|unlicense
license = WTFPL|wtfpl
Apache-2.0|apache-2.0
dual MIT/Apache-2.0|apache-2.0
http://www.apache.org/licenses/LICENSE-2.0|apache-2.0
see https://opensource.org/licenses/MIT for more|mit
https://opensource.org/license/bsd-3-clause|bsd
https://opensource.org/licenses/GPL-3.0|gpl-3.0
https://spdx.org/licenses/ISC.html|isc
https://choosealicense.com/licenses/mit/|mit
https://creativecommons.org/licenses/by/4.0/|cc-by-4.0
http://creativecommons.org/licenses/by-nc-sa/3.0/|cc-by-nc-sa-3.0
http://creativecommons.org/licenses/by-nd/|cc-by-nd
https://creativecommons.org/publicdomain/zero/1.0/|cc0-1.0
https://www.gnu.org/licenses/gpl-3.0.html|gpl-3.0
http://www.gnu.org/licenses/old-licenses/lgpl-2.1.txt|lgpl-2.1
https://www.gnu.org/licenses/agpl-3.0|agpl-3.0
https://www.gnu.org/licenses/fdl-1.3|gfdl-1.3
https://mozilla.org/MPL/2.0/|mpl-2.0
https://www.mozilla.org/en-US/MPL/2.0/|mpl-2.0
https://www.eclipse.org/legal/epl-v10.html|epl-1.0
http://www.boost.org/LICENSE_1_0.txt|boost-1.0
For more information, please refer to <https://unlicense.org>|unlicense
BSD licensed|bsd
zlib licensed code|zlib
the LGPL license|lgpl
under the Apache-2.0 license|apache-2.0"""
MISSES = """Apache 2.0 is a web server of old
a driver's license mit Foto
he took license python bit him
the license apache helicopter
mit der Bahn
licensed plumber
artistic freedom
opensource.org is a site
creativecommons.org/about
www.gnu.org/software/emacs
apache.org/foundation
a license: none of these
boost the signal
isc bind resolver"""


def labels(text):
    raw = text.lower().encode()
    return set(filter(None, licenses._scan(raw)[4].split(","))) if licenses.gate().search(raw) else set()


def test_forms():
    for line in FORMS.split("\n"):
        text, label = line.rsplit("|", 1)
        assert labels(text) == {label}, text


def test_near_misses():
    for text in MISSES.split("\n"):
        assert labels(text) == set(), text


def test_work_is_linear():
    """A megabyte full of matches, and a quarter of it."""
    line = b'"license": "mit", licensed under the gnu general public license version 2.0, see http://www.apache.org/licenses/license-2.0 gplv3 mit license\n'
    licenses._scan(line)
    seconds = []
    for size in (1 << 18, 1 << 20):
        began = time.process_time()
        licenses._scan(line * (size // len(line)))
        seconds.append(time.process_time() - began)
    print(seconds)
    assert seconds[1] < 8 * seconds[0]
