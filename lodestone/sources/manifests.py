"""Edits of single manifest files on the driver: a module is added where it is not yet named, and the old file stays as <name>.old. No Spark job."""

from __future__ import annotations

import json
import re
import shutil

# Fixed value: the method that lists added modules in a target file.
METHOD = "RegisterModulesCreatedByNeovim"
_CSHARP = re.compile(r"""//[^\n]*|/\*.*?\*/|@"(?:""|[^"])*"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|[{}]""", re.S)


def _replace(path: str, text: str) -> None:
    shutil.copyfile(path, path + ".old")
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def add_to_project(path: str, name: str, kind: str = "Runtime", phase: str = "Default") -> bool:
    """Adds an entry to the Modules array, made as the last pair if there is none. False and no change if the name is there."""
    with open(path, encoding="utf-8-sig") as f:
        text = f.read()
    root = json.loads(text)
    if not isinstance(root, dict):
        raise ValueError("the manifest is no object")
    listed = root.setdefault("Modules", [])
    if any(m.get("Name") == name for m in listed):
        return False
    listed.append({"Name": name, "Type": kind, "LoadingPhase": phase})
    indent = re.search(r"\n([ \t]+)\S", text)
    _replace(path, json.dumps(root, indent=indent.group(1) if indent else "\t", ensure_ascii=False) + ("\n" if text.endswith("\n") else ""))
    return True


def _block(text: str, start: int) -> tuple[int, int]:
    """Places of the first brace after start and of the one that closes it; braces in texts and comments do not count."""
    depth, first = 0, None
    for m in _CSHARP.finditer(text, start):
        if m.group() == "{":
            first = m.start() if first is None else first
            depth += 1
        elif m.group() == "}" and first is not None:
            depth -= 1
            if depth == 0:
                return first, m.start()
    raise ValueError("unbalanced braces")


def _before_close(text: str, close: int, added: str) -> str:
    """added on lines of its own before a closing brace."""
    at = len(text[:close].rstrip(" \t"))
    return text[:at] + ("" if text[:at].endswith("\n") else "\n") + added + text[at:]


def with_target_module(text: str, name: str, method: str = METHOD) -> str:
    """A target file's text whose constructor calls the method, and whose method adds the module."""
    head = re.search(r"class\s+(\w+)\s*:\s*TargetRules", text)
    if not head:
        raise ValueError("no target class")
    maker = re.search(rf"\b{head.group(1)}\s*\([^)]*\)", text[head.end() :])
    if not maker:
        raise ValueError("no constructor")
    step = re.search(r"\n([ \t]+)\S", text)
    tab = step.group(1) if step else "\t"
    first, close = _block(text, head.end() + maker.end())
    if not re.search(rf"\b{method}\s*\(\s*\)\s*;", text[first:close]):
        text = _before_close(text, close, f"{tab * 2}{method}();\n")
    entry, opening = f'{tab * 3}"{name}"\n', f"{tab * 2}ExtraModuleNames.AddRange(new string[] {{\n"
    own = re.search(rf"\bvoid\s+{method}\s*\(\s*\)", text)
    if not own:
        return _before_close(text, _block(text, head.end())[1], f"{tab}private void {method}()\n{tab}{{\n{opening}{entry}{tab * 2}}});\n{tab}}}\n")
    first, close = _block(text, own.end())
    call = re.search(r"ExtraModuleNames\s*\.\s*AddRange\s*\(\s*new\s+string\s*\[\s*\]\s*", text[first:close])
    if not call:
        return _before_close(text, close, f"{opening}{entry}{tab * 2}}});\n")
    first, close = _block(text, first + call.end())
    names = list(re.finditer(r'"([^"]*)"', text[first:close]))
    if name in [m.group(1) for m in names]:
        return text
    at = first + (names[-1].end() if names else 1)
    return text[:at] + ("," if names else "") + "\n" + entry.rstrip("\n") + ("\n" + tab * 2 if "\n" not in text[at:close] else "") + text[at:].lstrip(" ,")


def add_to_target(path: str, name: str, method: str = METHOD) -> bool:
    with open(path, encoding="utf-8-sig") as f:
        text = f.read()
    changed = with_target_module(text, name, method)
    if changed != text:
        _replace(path, changed)
    return changed != text
