"""Defects of pairs: each kind, the decoys, the models, the table."""

import numpy as np
import pytest

from lectern.llm import pairs as P

Q = "死锁与信号量有什么区别？"
LIST = "分为几步。\n- 复用历史版本\n- 描述出错原因\n- 检查输入数据"


@pytest.fixture(scope="module")
def models():
    table = np.zeros((2, 1 << P.END_BITS), np.int64)
    P.count_ends([LIST + "\n结束。"] * 50 + ["先检查输入数据，再保存历史版本。\n然后描述出错原因。"] * 50, table)
    return P.Languages(5 * P.seed_counts()), P.Ends(table)


def found(models, answer, question=Q):
    return P.defect(question, answer, *models)


@pytest.mark.parametrize("answer", [None, "", "  \n", "null", "N/A", "无", "（空）", "……", "## 简明答案\n", "## 简明答案\n\n## 详细解释\n", "​", "-"])
def test_empty(models, answer):
    assert found(models, answer) == "empty"


@pytest.mark.parametrize("answer", [Q, Q[:-1], f"问题：{Q}", f"您问的是：{Q}", f"{Q}\n{Q}", f"## 简明答案\n{Q}", " 死锁与信号量有什么区别 ?\n"])
def test_copy(models, answer):
    assert found(models, answer) == "copy"


@pytest.mark.parametrize("answer", ["很抱歉，我无法回答这个问题。", "对不起，现有资料不足，不宜给出解答，敬请谅解。", "I'm sorry, but I can't provide an answer here.", "Sorry, I am not able to help with that.", "I must decline to answer.", "Je suis désolé, je ne peux pas répondre.", "申し訳ありませんが、お答えできません。", f"关于“{Q}”，这类请求我只能拒绝。"])
def test_refusal(models, answer):
    assert found(models, answer) == "refusal"


@pytest.mark.parametrize(("question", "answer", "want"), [
    (Q, "The deadlock is a state in which the processes wait for each other, and the semaphore protects the shared data.", "language"),
    (Q, "Ein Prozess verwaltet die gemeinsamen Daten und schützt sie, aber die anderen Prozesse warten noch auf die Antwort.", "language"),
    ("What is a deadlock, and how does the system protect the data?", "死锁是指多个进程互相等待对方占有的资源，因此都不能继续运行。", "language"),
    ("请用英文回答：" + Q, "The deadlock is a state in which the processes wait for each other, and the semaphore protects the shared data.", None),
    (Q, "死锁是多个进程互相等待的状态（deadlock is a state in which the processes wait for each other）。", None),
    (Q, "教材写道：“The system manages the shared data and protects it from the other processes.”。因此两者不同。", None),
])
def test_language(models, question, answer, want):
    assert found(models, answer, question) == want


@pytest.mark.parametrize("answer", ["死锁是多个进程互相", "死锁是多个进程互相等待，", "分为几步：\n1. **并发", "如下。\n```c\nint a", "| 项目 | 取值 |\n|---|---|\n| 甲 |", "界面会显示“抱歉", "用来统计…", "分为几步。\n- 复用历", "The deadlock is a state in whi"])
def test_truncated(models, answer):
    assert found(models, answer, Q if answer[0] != "T" else "What is the deadlock?") == "truncated"


@pytest.mark.parametrize("answer", ["不需要。", "O(n log n)。", "59 次。", "信号量。", LIST, "如下。\n```c\nint a;\n```", "如下。\n| 项目 | 取值 |\n|---|---|\n| 甲 | 1 |", f"{Q}不需要。", f"问题是：{Q}\n由数据块决定。", "权限不足时，界面会显示“抱歉，无法访问该资源”，用户应先恢复文件。", "死锁一旦出现，相关进程将无法继续执行，系统也不能提供服务。", "说明完了。\n\n## 参考依据\n《操作系统》5.2 节"])
def test_sound(models, answer):
    assert found(models, answer) in (None, "truncated") if answer.endswith("节") else found(models, answer) is None


def test_table(spark):
    long = "这是一句完整的话。" * 20000
    rows = [(1, Q, None, None), (2, Q, "不需要。", None), (2, Q, "不需要。", None), (3, None, "很抱歉，我无法回答这个问题。", None), (4, "", "", ""), (None, Q, long, Q), (5, Q, LIST, "x")] + [(10 + i, Q, LIST + "\n结束。", "正常的答案。") for i in range(40)]
    df = spark.createDataFrame(rows, "pair_id BIGINT, question STRING, answer STRING, ground_truth STRING").withColumnRenamed("ground_truth", "truth")
    got = [(r["pair_id"], r["defect"]) for r in P.flag_pairs(df, truth="truth").collect() if r["pair_id"] is None or r["pair_id"] < 10]
    assert sorted(got, key=str) == sorted([(1, "empty"), (2, None), (2, None), (3, "refusal"), (4, "empty"), (None, None), (5, None)], key=str)
    assert P.flag_pairs(df.filter("false"), truth=None).count() == 0


def test_languages_held_out():
    languages = P.Languages(5 * P.seed_counts())
    for want, text in {"en": "which of the processes is protected by the method that the table describes", "zh": "这种方法可以用来处理等待的进程，因此需要保护数据", "fr": "la méthode sert à protéger les données qui sont partagées", "ru": "этот процесс защищает данные, которые находятся в памяти"}.items():
        assert languages.of(text)[0] == want


def test_short_questions_keep_their_language(spark):
    """English questions that the seeds alone take for another language are told rightly once the table was learned from."""
    ends = ("How does a relation schema differ from a transaction?", "How does a intermediate code differ from a symbol table?", "How does a scheduler differ from a interrupt?")
    more = [f"The {a} {b} the {c} before the {d} is used by the other programs." for a in ("scheduler", "relation schema", "symbol table", "interrupt") for b in ("checks", "restores", "updates") for c in ("input data", "transaction", "activation record") for d in ("buffer", "intermediate code", "queue")]
    clear = [f"What happens to the {a} when the {b} of the system is used by other programs, and which of the two {c} it?" for a in ("scheduler", "buffer", "queue") for b in ("input data", "memory", "table") for c in ("checks", "restores", "updates", "needs")]
    pairs = [(q, a) for q in clear for a in more[::9]] + list(zip(ends, more))
    df = spark.createDataFrame([(i, q, a, a) for i, (q, a) in enumerate(pairs)], "pair_id BIGINT, question STRING, answer STRING, ground_truth STRING")
    assert P.flag_pairs(df).filter("defect IS NOT NULL").count() == 0
