"""PHP sources for tests, written for their shapes and line numbers."""


def tally(name, rows, out, key, val):
    return f"""<?php
function {name}(${rows}) {{
    ${out} = [];
    foreach (${rows} as ${key} => ${val}) {{
        if (${val} > 7) {{
            ${out}[${key}] = ${val} * 5 + 4;
        }} else {{
            ${out}[${key}] = ${val} * 6 - 8;
        }}
    }}
    return ${out};
}}
"""


def weigh(name, rows, out, one):
    return f"""<?php
function {name}(${rows}) {{
    ${out} = 0;
    foreach (${rows} as ${one}) {{
        if (${one} > 0) {{
            ${out} += ${one} * 4 + 9;
        }}
    }}
    return ${out};
}}
"""


WEIGH_LOOSE = """<?php
$w = 0;
foreach ($kilos as $k) {
    if ($k > 0) {
        $w += $k * 4 + 9;
    }
}
"""


def two(first, second, a, b, c, d, rows, i):
    return f"""<?php
function {first}(${a}) {{
    ${b} = ${a} + 6;
    ${c} = ${b} * 7;
    ${d} = ${c} - 9;
    return ${d} + ${b};
}}

function {second}(${a}) {{
    ${rows} = [];
    for (${i} = 0; ${i} < 25; ${i}++) {{
        ${rows}[] = ${a} * ${i};
    }}
    return ${rows};
}}
"""


def ledger(cls, m1, m2, m3, rows, acc, one, key):
    return f"""<?php declare(strict_types = 1);

namespace Ledgers;

use function is_float;
use function trim;

final class {cls}
{{

    public function {m1}(array ${rows}): int
    {{
        ${acc} = 0;
        foreach (${rows} as ${one}) {{
            if (${one} > 0) {{
                ${acc} += ${one};
            }}
        }}
        return ${acc};
    }}

    public function {m2}(array ${rows}): int
    {{
        ${acc} = 1;
        foreach (${rows} as ${one}) {{
            if (${one} > 0) {{
                ${acc} *= ${one};
            }}
        }}
        return ${acc};
    }}

    public function {m3}(array ${rows}): array
    {{
        ${acc} = [];
        foreach (${rows} as ${key} => ${one}) {{
            if (is_float(${one})) {{
                ${acc}[${key}] = ${one} * 3;
            }} else {{
                ${acc}[${key}] = trim(${one});
            }}
        }}
        return ${acc};
    }}

}}
"""


NESTED = {"A1.php": tally("tallyRows", "rows", "kept", "at", "n"), "A2.php": tally("tallyCells", "cells", "out", "i", "x")}
PARTIAL = {"P1.php": weigh("weigh", "boxes", "sum", "box"), "P2.php": weigh("weigh", "bags", "kg", "bag"), "Q.php": WEIGH_LOOSE}
APART = {"T1.php": two("stepA", "gridA", "p", "q", "r", "s", "cells", "i"), "T2.php": two("stepB", "gridB", "k", "l", "m", "n", "rows", "j")}
LEDGERS = {"L1.php": ledger("Ledger1", "addUp", "multiply", "clean", "sums", "total", "sum", "k"), "L2.php": ledger("Ledger2", "plus", "times", "tidy", "items", "out", "item", "index")}


def written(folder, sources):
    for name, text in sources.items():
        (folder / name).write_text(text)
    return [str(folder / name) for name in sorted(sources)]
