"""Sample workbooks: a baseline by roles with a users sheet, an export by users, and a catalog, with planted differences."""

from __future__ import annotations

from .sinks import Sheet, workbook

ROLES = ["Provider", "Front Desk", "Nurse", "Biller", "Practice Admin"]
AREAS = ["Charts", "Billing", "Orders", "Reports", "Messages", "Admin"]
SETTINGS = [(AREAS[k // 6], f"{AREAS[k // 6]} task {'abcdef'[k % 6]}") for k in range(36)]
USERS = {"Ann Bell": "Provider", "Cy Dorn": "Provider", "Eve Fox": "Front Desk", "Gus Hall": "Front Desk", "Ida Judd": "Nurse", "Kim Lowe": "Nurse", "Max Noll": "Biller", "Ola Pratt": "Practice Admin", "Quin Rost": "Nurse"}


def held(role: str, k: int) -> bool:
    return (k * 7 + ROLES.index(role) * 3) % 5 < 2 + (role == "Practice Admin")


def where(role: str, granted: bool) -> int:
    return next(k for k in range(36) if held(role, k) == granted)


def sample() -> tuple[bytes, bytes, bytes]:
    """(baseline workbook, export workbook, catalog workbook) with planted differences: three grants too many, two too few, one level, a user of each side alone, a setting outside the baseline."""
    grid = [["Category", "Security Setting", "What it controls", *ROLES], *([a, s, f"About {s}", *("Y" if held(r, k) else "N" for r in ROLES)] for k, (a, s) in enumerate(SETTINGS))]
    baseline = workbook([Sheet("Permissions", grid), Sheet("Users", [["User", "Role"], *map(list, USERS.items())])])
    values = {(u, k): "Y" if held(r, k) else "N" for u, r in USERS.items() for k in range(36)}
    for user, granted in (("Eve Fox", False), ("Ida Judd", False)):
        values[user, where(USERS[user], granted)] = "Y"
    for user in ("Ann Bell", "Max Noll"):
        values[user, where(USERS[user], True)] = "N"
    values["Kim Lowe", where("Nurse", True)] = "View Only"
    rows = [["Practice Cloud"], ["User security settings"], ["Printed 1/2"], ["User Name", "Category", "Security Setting", "Value"]]
    for user in [u for u in USERS if u != "Quin Rost"]:
        own = [[a, s, values[user, k]] for k, (a, s) in enumerate(SETTINGS)] + [["Messages", "Blast message", "Y" if USERS[user] == "Provider" else "N"]]
        rows += [[user.upper() if i == 0 else "", *x] for i, x in enumerate(own)]
    rows += [["TEMP 1" if k == 0 else "", a, s, "Y" if k < 3 else "N"] for k, (a, s) in enumerate(SETTINGS)]
    export = workbook([Sheet("Security Settings", rows, freeze=0)])
    extra = [("Messages", "Blast message")] + [(AREAS[k % 6], f"Further {k}") for k in range(19)]
    listed = [["Security Setting Name", "Security Setting Description", "Security Setting Type", "Security group Name"], *([s, f"About {s}", "Old", a] for a, s in SETTINGS + extra)]
    return baseline, export, workbook([Sheet("Sheet1", listed)])
