"""Direct dependencies of a Maven project: parents, properties, interpolation and managed versions.

A project's own files are few, so this runs where it is called, on local paths; the jars that it names are read by Spark.
"""

from __future__ import annotations

import logging
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from pathlib import Path

MOST_PARENTS, MOST_SUBSTITUTIONS = 10, 5
log = logging.getLogger(__name__)


@dataclass
class Project:
    group: str = ""
    artifact: str = ""
    version: str = ""
    properties: dict[str, str] = field(default_factory=dict)
    managed: dict[tuple[str, str], str] = field(default_factory=dict)
    dependencies: list[tuple[str, str, str, str]] = field(default_factory=list)


def interpolate(text: str, properties: dict[str, str]) -> str:
    """Replace `${name}`, a few times over for values that name others; unknown names stay."""
    for _ in range(MOST_SUBSTITUTIONS):
        new = re.sub(r"\$\{([^}]+)\}", lambda m: properties.get(m[1].strip(), m[0]), text)
        if new == text:
            break
        text = new
    return text


def read(pom: Path, repository: Path, depth: int = 0) -> Project:
    """The project of a pom file with what it inherits. More than ten parents is an error; a missing parent is left out."""
    if depth > MOST_PARENTS:
        raise ValueError(f"{pom}: over {MOST_PARENTS} parents")
    root = ET.fromstring(re.sub(r'\sxmlns="[^"]*"', "", pom.read_text(encoding="utf-8"), count=1))
    get = lambda e, name: (e.findtext(name) or "").strip()
    out, parent = Project(), root.find("parent")
    if parent is not None:
        relative = get(parent, "relativePath") or "../pom.xml"
        near = pom.parent / relative
        near = near / "pom.xml" if near.is_dir() else near
        far = repository / get(parent, "groupId").replace(".", "/") / get(parent, "artifactId") / get(parent, "version") / f"{get(parent, 'artifactId')}-{get(parent, 'version')}.pom"
        found = next((p for p in (near, far) if p.is_file()), None)
        if found:
            try:
                up = read(found, repository, depth + 1)
                out = Project(up.group, "", up.version, dict(up.properties), dict(up.managed), list(up.dependencies))
            except (ValueError, ET.ParseError) as e:
                log.warning("parent of %s left out: %s", pom, e)
        out.group, out.version = out.group or get(parent, "groupId"), out.version or get(parent, "version")
    out.group, out.artifact, out.version = get(root, "groupId") or out.group, get(root, "artifactId"), get(root, "version") or out.version
    out.properties |= {e.tag: (e.text or "").strip() for e in root.findall("properties/*")}
    for prefix in ("project", "pom"):
        out.properties |= {f"{prefix}.groupId": out.group, f"{prefix}.artifactId": out.artifact, f"{prefix}.version": out.version}
    fill = lambda e, name: interpolate(get(e, name), out.properties)
    for e in root.findall("dependencyManagement/dependencies/dependency"):
        out.managed[fill(e, "groupId"), fill(e, "artifactId")] = get(e, "version")
    out.dependencies += [(get(e, "groupId"), get(e, "artifactId"), get(e, "version"), get(e, "scope")) for e in root.findall("dependencies/dependency")]
    return out


def jars(pom: Path, repository: Path) -> list[Path]:
    """Jar files of the direct dependencies, those of tests and those without a version left out; a missing file is logged."""
    project, out = read(pom, repository), []
    for group, artifact, version, scope in project.dependencies:
        group, artifact = interpolate(group, project.properties), interpolate(artifact, project.properties)
        version = interpolate(version or project.managed.get((group, artifact), ""), project.properties)
        if scope == "test" or not version:
            continue
        jar = repository / group.replace(".", "/") / artifact / version / f"{artifact}-{version}.jar"
        if jar.is_file():
            out.append(jar)
        else:
            log.warning("%s: no %s", pom, jar)
    return list(dict.fromkeys(out))
