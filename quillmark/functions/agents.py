"""Agent prompts by template family: tools into the system prompt, tool calls and tool responses into turns.

The inverse of ``toolcall.PARSERS``, for the same keys. Tools are JSON texts,
calls JSON texts of a name and arguments (``parameters`` is read too). Two small
Arrow functions read them, keys in their order, and give the pieces that all
families are put together from; the rest is column expressions.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.jsons import read

TOOLS = "array<struct<name:string,human:string,about:string,parameters:string,raw:string,raw4:string,plain:string,plain4:string,wrapped:string,signature:string,listed:string>>"
CALLS = "array<struct<name:string,arguments:string,shown:string,whole:string,parameters:string,each:array<struct<key:string,shown:string,text:string,value:string>>>>"

# --- fixed values: the texts of the families

_REACT_TOOL = "{name}: Call this tool to interact with the {human} API. What is the {human} API useful for? {about} Parameters: {parameters} Format the arguments as a JSON object."
_REACT_TOOL_ZH = "{name}: 调用此工具与 {human} API 进行交互。{human} 有什么用？{about} 输入参数：{parameters} 此工具的输入应为JSON对象。"
_REACT = """Answer the following questions as best you can. You have access to the following tools:

{tools}

Use the following format:

Question: the input question you must answer
Thought: you should always think about what to do
Action: the action to take, should be one of [{names}]
Action Input: the input to the action
Observation: the result of the action
... (this Thought/Action/Action Input/Observation can be repeated zero or more times)
Thought: I now know the final answer
Final Answer: the final answer to the original input question

Begin!
"""
_REACT_ZH = """尽可能地回答以下问题。你可以使用以下工具:

{tools}

请按照以下格式进行:

Question: 需要你回答的输入问题
Thought: 你应该总是思考该做什么
Action: 需要使用的工具，应该是[{names}]中的一个
Action Input: 传入工具的内容
Observation: 行动的结果
... (这个Thought/Action/Action Input/Observation可以重复N次)
Thought: 我现在知道最后的答案
Final Answer: 对原始输入问题的最终答案

现在开始！
"""
_REACT_GRPO = """A conversation for tool calling between User and Assistant. The user asks a question which may be solved by calling tools, and the Assistant solves it. The assistant first thinks about the reasoning process in the mind and then provides the user with the answer. The reasoning process should be enclosed within <think> </think>tags and answer should follow the ReACT format(Action:xxx
Action Input:xxx), i.e., <think> reasoning process here </think> Action: action here
Action Input: parameters here

Answer the following questions as best as you can. You have access to the following tools:

{tools}

Use the following format:

<think>you should always think about what to do</think>
Action: the action to take, should be one of [{names}]
Action Input: the input to the action
Observation: the result of the action, given by the actual calling
... (this Thought/Action/Action Input/Observation can be repeated zero or more times)
Final Answer: the final answer to the original input question

Begin!
"""
_QWEN_TOOL = "### {human}\n\n{name}: {about} Parameters: {parameters} Format the arguments as a JSON object."
_QWEN_TOOL_ZH = "### {human}\n\n{name}: {about} 输入参数：{parameters} 此工具的输入应为JSON对象。"
_QWEN_HEAD = "{system}\n\n# Tools\n\n## You have access to the following tools:\n\n{tools}\n\n"
_QWEN_HEAD_ZH = "{system}\n\n# 工具\n\n## 你拥有如下工具：\n\n{tools}\n\n"
_QWEN = _QWEN_HEAD + """## When you need to call a tool, please insert the following command in your reply, which can be called zero or multiple times according to your needs:

✿FUNCTION✿: The tool to use, should be one of [{names}]
✿ARGS✿: The input of the tool
✿RESULT✿: Tool results
✿RETURN✿: Reply based on tool results. Images need to be rendered as ![](url)"""
_QWEN_ZH = _QWEN_HEAD_ZH + """## 你可以在回复中插入零次、一次或多次以下命令以调用工具：

✿FUNCTION✿: 工具名称，必须是[{names}]之一。
✿ARGS✿: 工具输入
✿RESULT✿: 工具结果
✿RETURN✿: 根据工具结果进行回复，需将图片用![](url)渲染出来"""
_QWEN_PARALLEL = _QWEN_HEAD + """## Insert the following command in your reply when you need to call N tools in parallel:

✿FUNCTION✿: The name of tool 1, should be one of [{names}]
✿ARGS✿: The input of tool 1
✿FUNCTION✿: The name of tool 2
✿ARGS✿: The input of tool 2
...
✿FUNCTION✿: The name of tool N
✿ARGS✿: The input of tool N
✿RESULT✿: The result of tool 1
✿RESULT✿: The result of tool 2
...
✿RESULT✿: he result of tool N
✿RETURN✿: Reply based on tool results. Images need to be rendered as ![](url)"""
_QWEN_PARALLEL_ZH = _QWEN_HEAD_ZH + """## 你可以在回复中插入以下命令以并行调用N个工具：

✿FUNCTION✿: 工具1的名称，必须是[{names}]之一
✿ARGS✿: 工具1的输入
✿FUNCTION✿: 工具2的名称
✿ARGS✿: 工具2的输入
...
✿FUNCTION✿: 工具N的名称
✿ARGS✿: 工具N的输入
✿RESULT✿: 工具1的结果
✿RESULT✿: 工具2的结果
...
✿RESULT✿: 工具N的结果
✿RETURN✿: 根据工具结果进行回复，需将图片用![](url)渲染出来"""
_HERMES = """{system}

# Tools

You may call one or more functions to assist with the user query.

You are provided with function signatures within <tools></tools> XML tags:
<tools>
{tools}
</tools>

For each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:
<tool_call>
{"name": <function-name>, "arguments": <args-json-object>}
</tool_call>"""
_HUNYUAN = """{system+}# Tools

You may call one or more functions to assist with the user query.

You are provided with function signatures within <tools></tools> XML tags:
<tools>
{tools}
</tools>

For function call returns, you should first print <tool_calls>For each function call, you should return object like:
<tool_call>function_name
```json
function_arguments_in_json_format
```</tool_call>At the end of function call returns, you should print </tool_calls>"""
_TOOLBENCH = """You can use many tools(functions) to do the following task.
First I will give you the task description, and your task start.
At each step, you need to give your thought to analyze the status now and what to do next, with a function call to actually execute your step. Your output should follow this format:
Thought:
Action:
Action Input:

After the call, you will get the call result, and you are now in a new state.
Then you will analyze your status now, then decide what to do next...
After many (Thought-call) pairs, you finally perform the task, then you can give your final answer.
Remember:
1.the state change is irreversible, you can't go back to one of the former state, if you want to restart the task, say "I give up and restart".
2.All the thought is short, at most in 5 sentence.
3.You can do more then one try, so if your plan is to continuously try some conditions, you can do one of the conditions per try.
Let's Begin!
Task description: You should use functions to help handle the real time user queries. Remember:
1.ALWAYS call "Finish" function at the end of the task. And the final answer should contain enough information to show to the user,If you can't handle the task, or you find that function calls always fail(the function is not valid now), use function Finish->give_up_and_restart.
2.Do not use origin tool names, use only subfunctions' names.
Specifically, you have access to the following APIs: [{tools}]"""
_GLM4_SYSTEM = "你是一个名为 GLM-4 的人工智能助手。你是基于智谱AI训练的语言模型 GLM-4 模型开发的，你的任务是针对用户的问题和要求提供适当的答复和支持。\n\n"
_GLM4_TOOL = "## {name}\n\n{plain4}\n在调用上述函数时，请使用 Json 格式表示调用的参数。"
_GLM4_5 = """# Tools

You may call one or more functions to assist with the user query.

You are provided with function signatures within <tools></tools> XML tags:
<tools>
{tools}
</tools>

For each function call, output the function name and arguments within the following XML format:
"""
_GLM4_5_CALL = """<tool_call>{function-name}
<arg_key>{arg-key-1}</arg_key>
<arg_value>{arg-value-1}</arg_value>
<arg_key>{arg-key-2}</arg_key>
<arg_value>{arg-value-2}</arg_value>
...
</tool_call>"""
_LLAMA = """Given the following functions, please respond with a JSON for a function call with its proper arguments that best answers the given prompt.

Respond in the format {"name": function name, "parameters": dictionary of argument name and its value}. Do not use variables.

{tools}

"""
_DEEPSEEK_TOOL = "### {name}\nDescription: {about}\n\nParameters: {parameters}"
_DEEPSEEK = """{system}

## Tools
You have access to the following tools:

{tools}

IMPORTANT: ALWAYS adhere to this exact format for tool use:
<｜tool▁calls▁begin｜><｜tool▁call▁begin｜>tool_call_name<｜tool▁sep｜>tool_call_arguments<｜tool▁call▁end｜>{additional_tool_calls}<｜tool▁calls▁end｜>

Where:
- `tool_call_name` must be an exact match to one of the available tools
- `tool_call_arguments` must be valid JSON that strictly follows the tool's Parameters Schema
- For multiple tool calls, chain them directly without separators or spaces"""
_MINIMAX = """{system}

# Tools
You may call one or more tools to assist with the user query.
Here are the tools available in JSONSchema format:

<tools>
{tools}
</tools>

When making tool calls, use XML format to invoke tools and pass parameters:

<minimax:tool_call>
<invoke name="tool-name-1">
<parameter name="param-key-1">param-value-1</parameter>
<parameter name="param-key-2">param-value-2</parameter>
...
</invoke>
</minimax:tool_call>"""
_YOUTU = """{system+}<|begin_of_tool_description|>Tool calling capabilities.
You may call one or more functions to assist with the user query. You have the following functions available:
{tools}
For tool call returns, you MUST use the following format:
<tool_call>{"name": "function-name", "arguments": {"param1": "value1", "param2": "value2"}}</tool_call>
<|end_of_tool_description|>"""
_CODER_SYSTEM = "You are Qwen, a helpful AI assistant that can interact with a computer to solve tasks."
_CODER_SUFFIX = """</tools>

If you choose to call a function ONLY reply in the following format with NO suffix:

<tool_call>
<function=example_function_name>
<parameter=example_parameter_1>
value_1
</parameter>
<parameter=example_parameter_2>
This is the value for the second parameter
that can span
multiple lines
</parameter>
</function>
</tool_call>

<IMPORTANT>
Reminder:
- Function calls MUST follow the specified format: an inner <function=...></function> block must be nested within <tool_call></tool_call> XML tags
- Required parameters MUST be specified
- You may provide optional reasoning for your function call in natural language BEFORE the function call, but NOT after
- If there is no function call available, answer the question like normal with your current knowledge and do not tell the user about function calls
</IMPORTANT>"""
_CODER = "{system}\n\n# Tools\n\nYou have access to the following functions:\n\n<tools>\n{tools}\n" + _CODER_SUFFIX
_CODER_5 = "# Tools\n\nYou have access to the following functions:\n\n<tools>\n{tools}\n" + _CODER_SUFFIX
_SEED_SYSTEM = "You are Doubao, a helpful AI assistant. You may call one or more functions to assist with the user query."
_SEED_CALL = """工具调用请遵循如下格式:
<seed:tool_call>
<function=example_function_name>
<parameter=example_parameter_1>value_1</parameter>
<parameter=example_parameter_2>This is the value for the second parameter
that can span
multiple lines</parameter>
</function>
</seed:tool_call>"""
_SEED_SPLIT = "<seed:eos><seed:bos>system"
_SEED_TYPES = {"string": "str", "number": "int", "integer": "int", "boolean": "bool", "array": "list"}
_CODER_KEYS = (("type", "properties"), ("name", "type", "description"), ("type", "name", "description", "parameters"))

# --- reading tools and calls


def _json(x: Any, indent: int | None = None) -> str:
    return json.dumps(x, ensure_ascii=False, indent=indent)


def _signature(tool: dict) -> str:
    """A tool as the head and docstring of a function."""
    parameters = tool.get("parameters") or {}
    fields = {k: v for k, v in (parameters.get("properties") or {}).items() if isinstance(v, dict)}
    kind = lambda spec: _SEED_TYPES.get(spec.get("type", "any"), "Any")
    doc = [f"    {(tool.get('description') or '').strip()}"]
    if fields:
        doc.append("\n    Args:")
        for k, v in fields.items():
            doc.append(f"    - {k} ({kind(v)}) {'[必填]' if k in parameters.get('required', []) else '[选填]'}: {v.get('description', '')}")
    returned = (tool.get("returns") or {}).get("properties") or {}
    if returned:
        doc += ["\n    Returns:", *(f"    - {k} ({kind(v)}): {v.get('description', '')}" for k, v in returned.items())]
    return "\n".join([f"Function:\ndef {tool.get('name')}({','.join(f'{k}: {kind(v)}' for k, v in fields.items())}):", '    """', *doc, '\n    """'])


def _listed(tool: dict) -> str:
    """A tool as nested marks, a field that has no mark of its own under its name."""
    def rest(of: dict, but: tuple[str, ...]) -> list[str]:
        return [f"<{k}>{_json(v)}</{k}>" for k, v in of.items() if k not in but]

    parameters = tool.get("parameters")
    out = [f"<function>\n<name>{tool.get('name')}</name>"]
    out += [f"<description>{tool['description'].strip()}</description>"] if "description" in tool else []
    out.append("<parameters>")
    for name, spec in ((parameters or {}).get("properties") or {}).items() if isinstance(parameters, dict) else ():
        out += ["<parameter>", f"<name>{name}</name>"]
        out += [f"<type>{spec['type']}</type>"] if "type" in spec else []
        out += [f"<description>{spec['description'].strip()}</description>"] if "description" in spec else []
        out += [*rest(spec, _CODER_KEYS[1]), "</parameter>"]
    out += rest(parameters, _CODER_KEYS[0]) if isinstance(parameters, dict) else []
    return "\n".join([*out, "</parameters>", *rest(tool, _CODER_KEYS[2]), "</function>"])


def _tool(text: str) -> dict[str, str | None] | None:
    try:
        tool = read(text, False)
    except ValueError:
        return None
    if not isinstance(tool, dict):
        return None
    plain = tool["function"] if "type" in tool and "function" in tool else tool
    name = plain.get("name_for_model") or plain.get("name")
    about = plain.get("description", plain.get("description_for_model"))
    parameters = plain.get("parameters") or {}
    wrapped = tool if "type" in tool or "function" in tool else {"type": "function", "function": tool}
    return {
        "name": name, "human": plain.get("name_for_human") or name, "about": about, "parameters": parameters if isinstance(parameters, str) else _json(parameters),
        "raw": _json(tool), "raw4": _json(tool, 4), "plain": _json(plain), "plain4": _json(plain, 4), "wrapped": _json(wrapped), "signature": _signature(plain) if plain.get("name") else None, "listed": _listed(plain),
    }


def _call(text: str) -> dict[str, Any] | None:
    try:
        call = read(text, False)
        arguments = call.get("arguments")
        arguments = call.get("parameters") if arguments is None else arguments
        arguments = read(arguments, False) if isinstance(arguments, str) else arguments
    except (ValueError, AttributeError):
        return None
    if arguments is None:
        return None
    items = arguments.items() if isinstance(arguments, dict) else ()
    each = [{"key": k, "shown": str(v), "text": v if isinstance(v, str) else _json(v), "value": json.dumps(v) if isinstance(v, (dict, list)) else str(v)} for k, v in items]
    return {"name": call.get("name"), "arguments": _json(arguments), "shown": str(arguments), "whole": _json({"name": call.get("name"), "arguments": arguments}), "parameters": _json({"name": call.get("name"), "parameters": arguments}), "each": each}


def _reader(kind: str, one: Callable[[str], dict | None]):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda texts: [x for x in map(one, (t for t in texts if t is not None)) if x is not None], na_action="ignore")

    return run


def read_tools(texts: Column) -> Column:
    """Pieces of each tool of an array of JSON texts; what is no object is left out."""
    return _reader(TOOLS, _tool)(texts)


def read_calls(texts: Column) -> Column:
    """Pieces of each call of an array of JSON texts; what has no arguments is left out."""
    return _reader(CALLS, _call)(texts)


# --- putting together


class Family(NamedTuple):
    """``tool`` and ``prompt`` name pieces in braces; ``{system+}`` is the system prompt and a blank line, or nothing."""

    prompt: str
    tool: str
    joint: str = "\n"
    action: str = "Action:"
    action_input: str = "Action Input:"
    observation: str = "Observation:"
    calls: Callable[[Column], Column] | None = None


def _filled(template: str, pieces: dict[str, Column]) -> Column:
    """The template with a piece wherever its name stands in braces; other braces stand for themselves."""
    parts, rest = [], template
    while True:
        found = [(rest.find("{" + k + "}"), k) for k in pieces if "{" + k + "}" in rest]
        if not found:
            return F.concat(*parts, F.lit(rest))
        at, k = min(found)
        parts += [F.lit(rest[:at]), F.coalesce(pieces[k], F.lit(""))]
        rest = rest[at + len(k) + 2 :]


def _mapped(rows: Column, template: str, names: tuple[str, ...]) -> Column:
    return F.transform(rows, lambda r: _filled(template, {n: r[n] for n in names}))


def _joined(sep: str, template: str, head: str = "", tail: str = "") -> Callable[[Column], Column]:
    return lambda calls: F.concat(F.lit(head), F.array_join(_mapped(calls, template, ("name", "arguments", "shown", "whole", "parameters")), sep), F.lit(tail))


def _by_argument(head: str, argument: str, foot: str, sep: str, inner: str, tail: str = "", before: str = "") -> Callable[[Column], Column]:
    """A call with a line for each argument."""
    def one(c: Column) -> Column:
        each = F.transform(c["each"], lambda a: _filled(argument, {n: a[n] for n in ("key", "shown", "text", "value")}))
        return F.concat(_filled(head, {"name": c["name"]}), F.array_join(each, inner), F.when(F.size(each) > 0, F.lit(inner)).otherwise(""), F.lit(foot))

    return lambda calls: F.concat(F.lit(before), F.array_join(F.transform(calls, one), sep), F.lit(tail))


_HERMES_CALL = "<tool_call>\n{whole}\n</tool_call>"
_CODER_CALLS = _by_argument("<tool_call>\n<function={name}>\n", "<parameter={key}>\n{value}\n</parameter>\n", "</function>\n</tool_call>", "\n", "")
_QWEN_MARKS = ("✿FUNCTION✿:", "✿ARGS✿:", "✿RESULT✿:")

FAMILIES: dict[str, Family] = {
    "react_en": Family(_REACT, _REACT_TOOL, "\n\n"),
    "react_zh": Family(_REACT_ZH, _REACT_TOOL_ZH, "\n\n"),
    "react_grpo": Family(_REACT_GRPO, _REACT_TOOL, "\n\n"),
    "toolbench": Family(_TOOLBENCH, "{plain}", ", "),
    "qwen_en": Family(_QWEN, _QWEN_TOOL, "\n\n", *_QWEN_MARKS),
    "qwen_zh": Family(_QWEN_ZH, _QWEN_TOOL_ZH, "\n\n", *_QWEN_MARKS),
    "qwen_en_parallel": Family(_QWEN_PARALLEL, _QWEN_TOOL, "\n\n", *_QWEN_MARKS),
    "qwen_zh_parallel": Family(_QWEN_PARALLEL_ZH, _QWEN_TOOL_ZH, "\n\n", *_QWEN_MARKS),
    "hermes": Family(_HERMES, "{wrapped}", calls=_joined("\n", _HERMES_CALL)),
    "hunyuan_hermes": Family(_HUNYUAN, "{wrapped}", calls=_joined("\n", _HERMES_CALL, "<tool_calls>\n", "\n</tool_calls>")),
    "youtu": Family(_YOUTU, "```json\n{wrapped}\n```", calls=_joined("", "<tool_call>{whole}</tool_call>")),
    "qwen3_coder": Family(_CODER, "{listed}", calls=_CODER_CALLS),
    "qwen3_5": Family(_CODER_5, "{wrapped}", calls=_CODER_CALLS),
    "chatglm4": Family(_GLM4_SYSTEM + "# 可用工具\n\n{tools}", _GLM4_TOOL, calls=_joined("<|assistant|>", "{name}\n{shown}", tail="<|observation|>")),
    "glm4": Family("# 可用工具\n\n{tools}", _GLM4_TOOL, calls=_joined("<|assistant|>", "{name}\n{shown}", tail="<|observation|>")),
    "glm4_5": Family(_GLM4_5 + _GLM4_5_CALL, "{raw}", calls=_by_argument(
        "<tool_call>{name}\n", "<arg_key>{key}</arg_key>\n<arg_value>{shown}</arg_value>", "</tool_call>", "\n", "\n", "<|observation|>")),
    "glm4_7": Family(_GLM4_5 + _GLM4_5_CALL.replace("\n", ""), "{raw}", calls=_by_argument(
        "<tool_call>{name}", "<arg_key>{key}</arg_key><arg_value>{shown}</arg_value>", "</tool_call>", "", "", "<|observation|>")),
    "llama3": Family(_LLAMA, "{raw4}", "\n\n", calls=_joined("\n", "{parameters}")),
    "llama4": Family(_LLAMA, "{raw4}", "\n\n", calls=_joined("\n", "{parameters}")),
    "deepseek_v3_1": Family(_DEEPSEEK, _DEEPSEEK_TOOL, "\n\n", calls=_joined(
        "", "<｜tool▁call▁begin｜>{name}<｜tool▁sep｜>{arguments}<｜tool▁call▁end｜>", "<｜tool▁calls▁begin｜>", "<｜tool▁calls▁end｜>")),
    "minimax_m2": Family(_MINIMAX, "<tool>{plain}</tool>", calls=_by_argument(
        '<invoke name="{name}">\n', '<parameter name="{key}">{text}</parameter>', "</invoke>", "\n", "\n", "\n</minimax:tool_call>", "<minimax:tool_call>\n")),
    "seed_oss": Family("", "{signature}", "\n\n", calls=_by_argument(
        "<seed:tool_call>\n<function={name}>\n", "<parameter={key}>{text}</parameter>", "</function>\n</seed:tool_call>", "\n", "\n")),
    "mistral": Family("{system}[AVAILABLE_TOOLS]{tools}[/AVAILABLE_TOOLS]", "{wrapped}", " ", calls=lambda calls: F.concat(
        F.lit("[TOOL_CALLS][\n"), F.array_join(_mapped(calls, "{whole}", ("whole",)), "\n"), F.lit("\n]</s>"))),
}
_TOOL_PIECES = ("name", "human", "about", "parameters", "raw", "raw4", "plain", "plain4", "wrapped", "signature", "listed")


def system_prompt(family: str, tools: Column, system: Column | None = None) -> Column:
    """The system prompt that offers the tools (of ``read_tools``); of llama families, what goes before the user's text.

    A null system prompt counts as empty, but for ``qwen3_coder``, which has one of its own.
    """
    f, given = FAMILIES[family], F.lit(None).cast("string") if system is None else system
    base = F.coalesce(given, F.lit(_CODER_SYSTEM if family == "qwen3_coder" else ""))
    descriptions = _mapped(tools, f.tool, _TOOL_PIECES)
    if family == "seed_oss":
        named = F.array_join(F.filter(descriptions, lambda d: d != ""), f.joint)
        at = F.instr(base, _SEED_SPLIT)
        inside = F.concat(F.substr(base, F.lit(1), at - 1), F.lit("\n\n"), named, F.lit(f"\n{_SEED_CALL}\n"), F.substr(base, F.greatest(at, F.lit(1)), F.length(base)))
        alone = F.concat(F.lit(f"{_SEED_SYSTEM}\n\n"), named, F.lit(f"\n{_SEED_CALL}\n{_SEED_SPLIT}\n"), base)
        return F.when(F.size(tools) == 0, base).when(at > 0, inside).otherwise(alone)
    prompt = _filled(f.prompt, {
        "system": base, "system+": F.when(base != "", F.concat(base, F.lit("\n\n"))).otherwise(""),
        "tools": F.array_join(descriptions, f.joint), "names": F.array_join(F.transform(tools, lambda t: t["name"]), ","),
    })
    if family in ("glm4_5", "glm4_7"):
        said = F.trim(base)
        return F.concat(prompt if family == "glm4_5" else F.concat(F.when(said == "", F.lit("\n")).otherwise(""), prompt), F.when(said != "", F.concat(F.lit("<|system|>\n"), said)).otherwise(""))
    if family == "qwen3_5":
        return F.concat(prompt, F.when(base != "", F.concat(F.lit("\n\n"), base)).otherwise(""))
    return prompt


def tool_calls(family: str, calls: Column) -> Column:
    """The assistant's text that makes the calls (of ``read_calls``)."""
    f = FAMILIES[family]
    if f.calls:
        return f.calls(calls)
    each = F.transform(calls, lambda c: F.concat(F.lit(f"{f.action} "), c["name"], F.lit(f"\n{f.action_input} "), c["shown"], F.lit("\n")))
    return F.concat(F.array_join(each, ""), F.lit(f.observation))


def tool_responses(family: str, said: Column, responses: Column) -> Column:
    """What follows the assistant's text ``said`` when an action of the ReAct form is answered, its end included; else the bare responses."""
    f = FAMILIES[family]
    acted = F.contains(said, F.lit(f.action)) & F.contains(said, F.lit(f.action_input))
    opened = F.when(F.endswith(said, F.lit(f.observation)), F.lit("")).otherwise(F.concat(F.when(F.endswith(said, F.lit("\n")), "").otherwise("\n"), F.lit(f.observation)))
    lines = F.transform(responses, lambda r: F.concat(r, F.when(F.endswith(r, F.lit("\n")), "").otherwise("\n")))
    return F.when(acted, F.concat(opened, F.array_join(lines, f.observation))).otherwise(_PLAIN_RESPONSES.get(family, lambda rs: F.array_join(rs, ""))(responses))


def _wrapped(head: str, tail: str, sep: str = "", before: str = "", after: str = "") -> Callable[[Column], Column]:
    return lambda rs: F.concat(F.lit(before), F.array_join(F.transform(rs, lambda r: F.concat(F.lit(head), r, F.lit(tail))), sep), F.lit(after))


_PLAIN_RESPONSES: dict[str, Callable[[Column], Column]] = {
    "hermes": _wrapped("<tool_response>\n", "\n</tool_response>", "\n", "<|im_end|>\n<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"),
    "hunyuan_hermes": _wrapped("<tool_response>", "</tool_response>", "\n", "<|im_end|>\n<|im_start|>user\n<tool_responses>", "</tool_responses><|im_end|>\n<|im_start|>assistant\n"),
    "youtu": _wrapped("<tool_response>", "</tool_response>", "\n", "<|end_of_text|><|User|>", "<|Assistant|>"),
    "chatglm4": _wrapped("", "", "<|observation|>\n", "\n", "<|assistant|>\n"),
    "glm4_5": _wrapped("\n<tool_response>\n", "\n</tool_response>", after="<|assistant|>\n"),
    "glm4_7": _wrapped("<tool_response>", "</tool_response>", after="<|assistant|>"),
    "llama3": _wrapped("<|start_header_id|>tool<|end_header_id|>\n\n", "<|eot_id|>", before="<|eot_id|>", after="<|start_header_id|>assistant<|end_header_id|>\n\n"),
    "llama4": _wrapped("<|header_start|>tool<|header_end|>\n\n", "<|eot|>", before="<|eot|>", after="<|header_start|>assistant<|header_end|>\n\n"),
    "deepseek_v3_1": _wrapped("<｜tool▁output▁begin｜>", "<｜tool▁output▁end｜>", before="<｜end▁of▁sentence｜>"),
    "minimax_m2": _wrapped("<response>", "</response>", "\n", "[e~[\n]~b]tool\n", "[e~[\n"),
    "seed_oss": _wrapped("<seed:bos>tool\n", "<seed:eos>", before="<seed:eos>", after="<seed:bos>assistant\n"),
}
for _same, _as in (("glm4", "chatglm4"), ("qwen3_coder", "hermes"), ("qwen3_5", "hermes")):
    _PLAIN_RESPONSES[_same] = _PLAIN_RESPONSES[_as]
