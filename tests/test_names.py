"""Every global name that a module's code reads is defined there or built in."""

import builtins
import dis
import importlib
import pkgutil
import types

import voltlake
from voltlake.plans import p_ops


def unknown_names(module):
    own, out, todo = vars(module), set(), [module.__loader__.get_code(module.__name__)]
    while todo:
        code = todo.pop()
        todo += [c for c in code.co_consts if isinstance(c, types.CodeType)]
        out |= {x.argval for x in dis.get_instructions(code) if x.opname in ("LOAD_GLOBAL", "LOAD_NAME")} - set(code.co_varnames)
    return {n for n in out if n not in own and not hasattr(builtins, n)}


def test_no_undefined_names():
    modules = [importlib.import_module(m.name) for m in pkgutil.walk_packages(voltlake.__path__, "voltlake.")]
    assert {m.__name__: u for m in modules if (u := unknown_names(m))} == {}


def test_policy_gate_knows_its_agents():
    assert "unlisted" not in p_ops.KNOWN_AGENTS and set(p_ops.AGENTS) - {"unlisted"} <= set(p_ops.KNOWN_AGENTS)
