"""Imports and types to files: equi joins with explicit precedence, never nested loops."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

EXTERNAL = ["org.freedesktop", "org.kde", "QML", "Quickshell", "QtQuick", "Qt"]
#: Types that no project declares, by the last part of their names.
BUILTIN = frozenset(
    "Row Column Grid Flow Item Text Image Label Page Pane Popup Menu MenuBar MenuItem Action State Timer Loader Layout Switch Slider "
    "Window PopupWindow FloatingWindow ApplicationWindow ShellRoot WlrLayershell HyprlandFocusGrab Process ShellCommand SplitParser "
    "StdioCollector QtObject Component Connections Behavior Repeater Instantiator Canvas Rectangle Gradient GradientStop BorderImage "
    "MouseArea TapHandler DragHandler HoverHandler PinchHandler PointHandler HandlerPoint WheelHandler RowLayout GridLayout ColumnLayout "
    "ListView ListModel ListElement Flickable FocusScope ScrollBar ScrollView ScrollIndicator SplitView StackView SwipeView SwipeDelegate "
    "SwitchDelegate CheckDelegate CheckBox ComboBox SpinBox GroupBox Button TabButton TabBar ToolBar ToolTip ToolButton ToolSeparator "
    "RoundButton RadioButton DelayButton AbstractButton ButtonGroup Control Dialog DialogButtonBox Drawer Tumbler RangeSlider ProgressBar "
    "BusyIndicator PageIndicator TextArea TextEdit TextField TextInput Transition StateGroup StateChangeScript PropertyAction ParentChange "
    "ParentAnimation PauseAnimation ColorAnimation AnchorAnimation NumberAnimation PropertyAnimation RotationAnimation ParallelAnimation "
    "SequentialAnimation ShaderEffect ShaderEffectSource SystemPalette".split()
)


class Resolution:
    def __init__(self, project) -> None:
        self.project, self.parsed, self.config = project, project.parsed, project.config

    @cached_property
    def entries(self) -> DataFrame:
        """qmldir entries whose file was scanned."""
        rows = self.parsed.where("kind = 'qmldir'").select(F.col("path").alias("qmldir"), "place", "module", F.posexplode("entries").alias("ord", "e")).select("qmldir", "place", "module", "ord", "e.*")
        return rows.join(self.parsed.select(F.col("path").alias("file")).hint("merge"), "file", "left_semi")

    @cached_property
    def modules(self) -> DataFrame:
        """The first qmldir of each module name."""
        named = self.parsed.where("kind = 'qmldir' and module is not null")
        return named.groupBy("module").agg(F.min_by("path", "place").alias("qmldir"))

    @cached_property
    def own_names(self) -> DataFrame:
        """(name, file) of each component."""
        return self.parsed.where("kind = 'qml'").select(F.regexp_replace(F.substring_index("path", "/", -1), r"\.qml$", "").alias("name"), F.col("path").alias("file"))

    @cached_property
    def names(self) -> DataFrame:
        """(name, files): what a type name may stand for in the whole project; ambiguous with two files or more."""
        own = self.own_names.union(self.entries.select("name", "file"))
        return own.groupBy("name").agg(F.array_sort(F.collect_set("file")).alias("files"))

    @cached_property
    def public_files(self) -> DataFrame:
        shell = self.parsed.where("kind = 'qml' and path like '%shell.qml'").select(F.col("path").alias("file"))
        return self.entries.where("public").select("file").union(shell).distinct()

    @cached_property
    def imports(self) -> DataFrame:
        """(file, ord, module, version, alias, line, kind, target)"""
        paths = self.parsed.select(F.col("path").alias("p"))
        folders = self.parsed.where(F.lower("path").endswith(".qml")).select(X.folder(F.col("path")).alias("d")).distinct()
        c, m = F.col("candidate"), F.col("module")
        # What an import stands for is found once for each module and place, and then led back to all that have it.
        rows = self.project.imports.select("module", "candidate").distinct()
        for name, key in (("as_file", c), ("as_qml", F.concat(F.when(c != "", c), F.lit(".qml"))), ("as_qmldir", F.when(c == "", "qmldir").otherwise(F.concat(c, F.lit("/qmldir"))))):
            rows = rows.withColumn("_k", key).join(paths.withColumnRenamed("p", name).hint("merge"), F.col("_k") == F.col(name), "left").drop("_k")
        rows = rows.withColumn("_k", F.when(c == "", ".").otherwise(c)).join(folders, F.col("_k") == F.col("d"), "left").drop("_k")
        rows = rows.join(self.modules, "module", "left")
        local = m.startswith(".") | m.contains("/") | F.lower(m).rlike(r"\.(?:js|mjs|qml)$")
        external = F.lit(False)
        for p in [*EXTERNAL, *self.config.external_modules]:
            external = external | (m == p) | m.startswith(p + ".")
        external = external | m.startswith("Qt")
        at = F.when(F.col("as_file").isNotNull(), F.struct(F.lit("local_file").alias("kind"), F.col("as_file").alias("target")))
        at = at.when(F.col("as_qml").isNotNull(), F.struct(F.lit("local_file").alias("kind"), F.col("as_qml").alias("target")))
        at = at.when(F.col("as_qmldir").isNotNull(), F.struct(F.lit("local_directory").alias("kind"), F.col("as_qmldir").alias("target")))
        at = at.when(F.col("d").isNotNull(), F.struct(F.lit("local_directory").alias("kind"), c.alias("target")))
        at = at.otherwise(F.struct(F.lit("unresolved").alias("kind"), F.lit(None).cast("string").alias("target")))
        other = F.when(F.col("qmldir").isNotNull(), F.struct(F.lit("local_module").alias("kind"), F.col("qmldir").alias("target")))
        other = other.when(external, F.struct(F.lit("external").alias("kind"), F.lit(None).cast("string").alias("target")))
        other = other.when(F.col("d").isNotNull(), at).otherwise(F.struct(F.lit("unresolved").alias("kind"), F.lit(None).cast("string").alias("target")))
        found = rows.select("module", "candidate", F.when(local, at).otherwise(other).alias("r")).hint("merge")
        return self.project.imports.join(found, ["module", "candidate"], "left").select("file", "ord", "module", "version", "alias", "line", F.col("r.kind").alias("kind"), F.col("r.target").alias("target"))

    @cached_property
    def targets(self) -> DataFrame:
        """(file, type, target) for the types each file uses and its scope knows.

        Components of the same folder come first; later imports without alias override; a later import with the same
        alias replaces the earlier one whole.
        """
        used = self.project.objects.select("file", "type").distinct()
        plain, dotted = used.where(~F.col("type").contains(".")), used.where(F.col("type").contains("."))
        comps = self.own_names.select("name", F.col("file").alias("target"), X.folder(F.col("file")).alias("folder"))
        own = plain.withColumn("folder", X.folder(F.col("file"))).withColumnRenamed("type", "name").join(comps.hint("merge"), ["folder", "name"]).select("file", F.col("name").alias("type"), "target", F.lit(-1).alias("at"), F.lit(0).alias("entry"))
        exports = (
            comps.select(F.col("target").alias("source"), "name", "target", F.lit(0).alias("entry"))
            .union(self.entries.select("qmldir", "name", "file", "ord"))
            .union(comps.select(F.when(F.col("folder") == ".", "").otherwise(F.col("folder")), "name", "target", F.lit(0)))
        )
        local = self.imports.where(F.col("kind").startswith("local")).select("file", F.col("ord").alias("at"), "alias", F.col("target").alias("source"))
        bare = plain.withColumnRenamed("type", "name").join(local.where("alias is null").hint("merge"), "file").join(exports.hint("merge"), ["source", "name"]).select("file", F.col("name").alias("type"), "target", "at", "entry")
        last = local.where("alias is not null").groupBy("file", "alias").agg(F.max_by("source", "at").alias("source"), F.max("at").alias("at"))
        named = dotted.withColumn("alias", F.substring_index("type", ".", 1)).withColumn("name", X.leaf(F.col("type"))).join(last.hint("merge"), ["file", "alias"]).join(exports.hint("merge"), ["source", "name"]).select("file", "type", "target", "at", "entry")
        return own.union(bare).union(named).groupBy("file", "type").agg(F.max_by("target", F.struct("at", "entry")).alias("target"))

    @cached_property
    def uses(self) -> DataFrame:
        """(file, ord, object_id, type, line, target, unresolved): objects of project types, known or not."""
        base = X.leaf(F.col("type"))
        candidate = base.rlike("^[A-Z]") & ~base.isin(*sorted(BUILTIN | set(self.config.external_types)))
        rows = self.project.objects.join(self.targets.hint("merge"), ["file", "type"], "left").withColumn("unresolved", F.col("target").isNull() & candidate)
        return self.project._keep(rows.where("target is not null or unresolved").select("file", "ord", "object_id", "type", "line", "target", "unresolved"), "uses")

    @cached_property
    def referenced(self) -> DataFrame:
        return self.uses.where("target is not null").select(F.col("target").alias("file")).distinct()
