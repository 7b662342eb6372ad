"""Things of the driver: workspaces, tokens, steps, locks, job files, folders and repositories of sources, page clients."""

import os
import subprocess

import pytest

from tessera import control
from tessera.scope import Job, Refused, TokenStore, resolve_tenant


def test_profiles_and_workspaces():
    tools = ["a", "b", "c"]
    assert control.published(tools) == tools and control.published(tools, "lean", {"lean": {"b", "c"}}, ["c"]) == ["b"]
    with pytest.raises(KeyError):
        control.published(tools, "none")
    two = {"x": 1, "y": 2}
    assert control.choose_workspace(two, "x", {"X-Workspace": "y"}) == ("x", 1) and control.choose_workspace(two, "", {"X-Workspace": "y"}) == ("y", 2)
    assert control.choose_workspace({"x": 1}) == ("x", 1) and control.choose_workspace(two, default="y") == ("y", 2)
    for bad in (lambda: control.choose_workspace(two), lambda: control.choose_workspace(two, "z"), lambda: control.choose_workspace({})):
        with pytest.raises(control.NotChosen):
            bad()
    jobs = [Job("a", [], status="failed"), Job("a", [], status="succeeded"), Job("b", [], status="queued")]
    assert control.dashboard(jobs) == [{"tenant": "a", "jobs": 2, "failed": 1, "last": "succeeded"}, {"tenant": "b", "jobs": 1, "failed": 0, "last": "queued"}]
    assert control.capabilities(["z", "y"], ["q"])["corpora"] == ["y", "z"]


def test_texts_of_configuration():
    assert control.token_map("a=t, b = u:base ,, =x, c=") == {"a": ("t", None), "b": ("u", "base")}
    assert control.help_entries('8.3.27.1 = /a/b; "/c d"\n\n/e') == [("8.3.27.1", "/a/b"), (None, "/c d"), (None, "/e")]
    assert control.steps_of() == ["index", "callgraph", "vectorize"] and control.steps_of(["vectorize", "index"]) == ["index", "vectorize"]
    for bad in ({"wanted": []}, {"wanted": ["x"]}, {"reset": True}, {"tenant": "a@task/1"}):
        with pytest.raises(ValueError):
            control.steps_of(**bad)
    assert control.missing_index(Exception("There is no such vector schema index: x")) and not control.missing_index(Exception("timeout"))
    assert control.run_baseline(["index"], {"index": lambda: 0}) == ("warning", {"index": 0}) and control.run_baseline(["index"], {"index": lambda: 3})[0] == "succeeded"


def test_progress_and_lock(tmp_path):
    now, said = [0.0], []
    p = control.Progress(10, "x", said.append, clock=lambda: now[0])
    for _ in range(10):
        now[0] += 0.5
        p.advance()
    assert len(said) == 3 and said[0] == "x: 4/10, 2.0/s, 3 s left" and said[-1].startswith("x: 10/10")
    at = str(tmp_path / "lock")
    a, b = control.BuildLock(at), control.BuildLock(at)
    assert a.acquire() and not b.acquire()
    os.utime(at, (1, 1))
    assert b.acquire()  # its owner has not been heard of
    b.release()
    assert not os.path.exists(at) and a.acquire()


def test_job_files(tmp_path):
    at = str(tmp_path / "jobs.json")
    assert control.load_jobs(at) == []
    control.save_jobs(at, [Job("a", [("index", None)], "1", "running"), Job("b", [], "2", "warning", "w")])
    got = control.load_jobs(at)
    assert [(j.id, j.status, j.error) for j in got] == [("1", "failed", "the process ended"), ("2", "warning", "w")] and os.listdir(tmp_path) == ["jobs.json"]


def test_folders_and_repositories(spark, tmp_path):
    src = tmp_path / "src"
    (src / "d" / ".git").mkdir(parents=True)
    (src / "a.md").write_text("# T\nтекст")
    (src / "d" / "b.json").write_text('{"id": "1", "text": "x"}')
    (src / "d" / ".git" / "c.md").write_text("no")
    assert [os.path.relpath(f, src) for f in control.iter_files(str(src), ["**/*.json", "**/*"])] == ["d/b.json", "a.md"]
    assert control.safe_path(str(src), "d/b.json").endswith("b.json")
    os.symlink("/etc", src / "out")
    for bad in ("../x", "/etc/hosts", "out/hosts"):
        with pytest.raises(PermissionError):
            control.safe_path(str(src), bad)
    with pytest.raises(NotADirectoryError):
        control.materialize({"path": str(src / "none")}, str(tmp_path))
    with pytest.raises(ValueError):
        control.materialize({}, str(tmp_path))
    assert [r.external_id for r in control.build_source(spark, {"type": "its", "path": str(src)}).collect()] == ["1"]
    assert "a.md#1" in [r.external_id for r in control.build_source(spark, {"type": "git_artifacts", "path": str(src)}).collect()]
    with pytest.raises(ValueError):
        control.build_source(spark, {"type": "x"})
    run = lambda *a, at: subprocess.run(["git", "-C", str(at), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    one = tmp_path / "one"
    one.mkdir()
    run("init", "-b", "main", at=one)
    (one / "f").write_text("1")
    run("add", "f", at=one)
    run("commit", "-m", "x", at=one)
    copy = control.materialize({"repo": f"file://{one}", "branch": "main"}, str(tmp_path / "cache"))
    assert control.materialize({"repo": f"file://{one}", "branch": "main"}, str(tmp_path / "cache")) == copy
    assert control.pull(copy) == control.git(str(one), "rev-parse", "HEAD")
    (tmp_path / "cache" / os.path.basename(copy) / "g").write_text("2")
    with pytest.raises(RuntimeError, match="changes"):
        control.pull(copy)
    state = control.repositories([copy, str(tmp_path)])
    assert [(r["branch"], r["ahead"], r["behind"], r["changed"], r["folders"]) for r in state.values()] == [("main", 0, 0, 1, [copy])]


def test_page_client():
    answers = [(429, None, 3), (503, None, 0), (200, {"results": [1, 2], "next_cursor": "c"}, 0), (200, {"results": [3], "next_cursor": None}, 0)]
    slept, asked = [], []

    def send(path, params):
        asked.append(params)
        return answers.pop(0)

    assert control.PageClient(send, sleep=slept.append).descendants("p") == [1, 2, 3]
    assert slept == [3, 1.0] and asked[-1] == {"page_size": 100, "cursor": "c"}
    assert [s for _, s, _ in control.PageClient(lambda p, q: (404, None, 0)).pages(["a", "b"])] == [404, 404]
    for status in (403, 500):
        with pytest.raises(RuntimeError):
            control.PageClient(lambda p, q, s=status: (s, None, 0), retries=1, sleep=lambda s: None).get("/x", {})


def test_token_store():
    store = TokenStore(clock=lambda: 5.0)
    a, b = store.provision("t"), store.provision("t")
    assert a != b and a not in str(store.tenants) and resolve_tenant(a, {}, store.tenants) == "t"
    assert store.revoke("t") == 2 and store.revoke("t") == 0 and [w for _, w, _ in store.audit] == ["provision", "provision", "revoke", "revoke"]
    for bad in (lambda: resolve_tenant(a, {}, store.tenants), lambda: store.provision("")):
        with pytest.raises(Refused):
            bad()
