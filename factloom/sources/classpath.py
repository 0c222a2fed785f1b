"""Where a project's libraries are: told folders, IDEA files, a Gradle template, or nothing;
with the trail of what was tried."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from pathlib import Path
from xml.etree import ElementTree as ET

# Properties of the build template end in these, its library folders are named so.
LIBS_SUFFIX, HOME_SUFFIX = "_libs_path", "_home"
DEFAULT_FOLDERS = ["trd", "bos", "biz", "cus", "ext"]
#: Environment variable with the platform's home, where no property tells it.
HOME_VARIABLE = "FACTLOOM_PLATFORM_HOME"


@dataclass
class Classpath:
    status: str
    provider: str
    folders: list[str] = field(default_factory=list)
    modules: list[str] = field(default_factory=list)
    attempts: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def jars(self) -> int:
        """Jars directly in the folders."""
        return sum(1 for f in self.folders for p in Path(f).glob("*.jar"))


def _idea(root: Path, out: Classpath) -> bool:
    idea = root / ".idea"
    if not idea.is_dir() and not list(root.glob("*.iml")):
        out.attempts.append("idea: no .idea folder and no .iml file")
        return False
    modules = {p.stem: p for p in root.rglob("*.iml")}
    wanted = set()
    for path in modules.values():
        for e in ET.parse(path).iter("orderEntry"):
            if e.get("type") == "library" and e.get("name"):
                wanted.add(e.get("name"))
    known = {}
    for path in sorted((idea / "libraries").glob("*.xml")) if idea.is_dir() else []:
        for lib in ET.parse(path).iter("library"):
            urls = [r.get("url", "") for r in lib.findall("CLASSES/root")] + [d.get("url", "") for d in lib.findall("jarDirectory")]
            known[lib.get("name")] = urls
    for name in sorted(wanted):
        if name not in known:
            out.warnings.append(f"library {name} is not defined")
            continue
        for url in known[name]:
            place = re.sub(r"^(file|jar)://", "", url).split("!/")[0].replace("$PROJECT_DIR$", str(root))
            folder = place if os.path.isdir(place) else os.path.dirname(place)
            if not os.path.isdir(folder):
                out.warnings.append(f"missing: {place}")
            elif folder not in out.folders:
                out.folders.append(folder)
    out.modules = sorted(modules)
    out.attempts.append(f"idea: {len(modules)} modules, {len(out.folders)} folders")
    return bool(out.folders)


def _properties(path: Path) -> dict[str, str]:
    found = {}
    for line in path.read_text(encoding="utf-8", errors="replace").splitlines() if path.is_file() else []:
        name, sign, value = line.partition("=")
        if sign and not line.lstrip().startswith(("#", "!")):
            plain = name.strip().removeprefix("systemProp.")
            if plain not in found or name.strip().startswith("systemProp."):
                found[plain] = value.strip()
    return found


def _gradle(root: Path, out: Classpath) -> bool:
    settings = next((p for p in (root / "settings.gradle", root / "settings.gradle.kts") if p.is_file()), None)
    if settings is None:
        out.attempts.append("gradle: no settings file")
        return False
    known = _properties(root / "gradle.properties")
    home = next((v for k, v in known.items() if k.endswith(HOME_SUFFIX)), None) or os.environ.get(HOME_VARIABLE)
    below = sorted(Path(root, home).glob("*/lib")) if home else []
    libs = next((v for k, v in known.items() if k.endswith(LIBS_SUFFIX)), None) or (str(below[0]) if below else None)
    if libs is None or not os.path.isdir(os.path.join(root, libs)):
        out.attempts.append(f"gradle: no library root ({libs or 'not set'})")
        return False
    base = root / libs
    config = root / "config.gradle"
    names = re.findall(r'"\$\{\w*' + LIBS_SUFFIX + r'\}/([\w./-]+)"', config.read_text(encoding="utf-8", errors="replace")) if config.is_file() else DEFAULT_FOLDERS
    for name in names:
        if (base / name).is_dir():
            out.folders.append(str((base / name).resolve()))
        else:
            out.warnings.append(f"missing: {base / name}")
    for name in re.findall(r"""include\s*\(?\s*((?:['"][^'"]+['"]\s*,?\s*)+)""", settings.read_text(encoding="utf-8", errors="replace")):
        for module in re.findall(r"""['"]:?([^'"]+)['"]""", name):
            if (root / module.replace(":", "/")).is_dir():
                out.modules.append(module)
            else:
                out.warnings.append(f"module {module} has no folder")
    out.attempts.append(f"gradle: {len(out.folders)} folders below {base}")
    return bool(out.folders)


def discover(root: str, explicit: list[str] | None = None) -> Classpath:
    if explicit:
        missing = [f for f in explicit if not os.path.isdir(f)]
        found = [f for f in explicit if os.path.isdir(f)]
        return Classpath("ok" if found else "failed", "explicit", found, [], ["explicit"], [f"missing: {f}" for f in missing])
    attempts: list[str] = []
    for provider, reader in (("idea", _idea), ("gradle", _gradle)):
        out = Classpath("ok", provider, attempts=attempts)
        try:
            if reader(Path(root), out):
                return out
        except ET.ParseError as error:
            attempts.append(f"{provider}: {error}")
    return Classpath("none", "none", attempts=attempts)
