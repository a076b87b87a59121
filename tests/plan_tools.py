"""What tests read off an executed plan."""

import re


def exchanges_by(plan: str, key: str) -> list[str]:
    """What is below each exchange by ``key`` alone in a plan's tree."""
    lines, out = plan.splitlines(), []
    depth = [len(re.match(r"[ :|+\-]*", x)[0]) for x in lines]
    for i, x in enumerate(lines):
        if re.search(rf"Exchange hashpartitioning\({key}#\d+, \d+\)", x):
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i:end]))
    return out
