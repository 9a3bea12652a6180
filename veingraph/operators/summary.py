"""Summary metrics of a triple table: counts, histograms and hierarchies, explicit and implicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veingraph.functions.terms import OWL, RDF, RDFS, SKOS, TYPE, is_blank, is_iri, namespace
from veingraph.operators.degree import degree_all, degree_in, degree_max, degree_node_type, degree_out
from veingraph.plans.iteration import cut

RESOURCE = f"{RDFS}Resource"
def _n() -> Column:
    return F.count(F.lit(1))


def types(triples: DataFrame) -> DataFrame:
    """(i, class): a row for each type of each instance."""
    return triples.filter(F.col("p") == TYPE).select(F.col("s").alias("i"), F.col("o").alias("class"))


def num_triples(t: DataFrame) -> DataFrame:
    return t.agg(_n().alias("numtriples"))


def distinct_edges(t: DataFrame) -> DataFrame:
    return t.select(F.col("p").alias("DistinctEdges")).distinct()


def triples_per_edge(t: DataFrame) -> DataFrame:
    return t.groupBy(F.col("p").alias("property")).agg(_n().alias("count")).orderBy("count", "property")


def edge_occurrence(t: DataFrame) -> DataFrame:
    """(property, numprop): distinct subjects of each property."""
    return t.groupBy(F.col("p").alias("property")).agg(F.countDistinct("s").alias("numprop")).orderBy("numprop", "property")


def distinct_prop_per_object(t: DataFrame) -> DataFrame:
    """(p, num): distinct objects of each property."""
    return t.groupBy("p").agg(F.countDistinct("o").alias("num")).orderBy(F.desc("num"), "p")


def properties_per_subject(t: DataFrame) -> DataFrame:
    return t.groupBy("s").agg(F.countDistinct("p").alias("num")).orderBy(F.desc("num"), "s")


def properties_per_object(t: DataFrame) -> DataFrame:
    return t.groupBy("o").agg(F.countDistinct("p").alias("num")).orderBy(F.desc("num"), "o")


def typed_subj(t: DataFrame) -> DataFrame:
    return types(t).groupBy("class").agg(F.countDistinct("i").alias("numInstances"))


def class_triples(t: DataFrame) -> DataFrame:
    """(class, numTriplesPerClass): triples whose subject is an instance, by class."""
    per_subject = t.groupBy(F.col("s").alias("i")).agg(_n().alias("n"))
    return types(t).join(per_subject, "i").groupBy("class").agg(F.sum("n").alias("numTriplesPerClass"))


def class_prop_occurrence(t: DataFrame) -> DataFrame:
    """(class, property, numInstances): instances of a class that have a property other than their type."""
    used = t.filter(F.col("p") != TYPE).select(F.col("s").alias("i"), F.col("p").alias("property")).distinct()
    return types(t).distinct().join(used, "i").groupBy("class", "property").agg(_n().alias("numInstances"))


def common_class_prop(t: DataFrame) -> DataFrame:
    """(class, property): properties that every instance of a class has."""
    all_ = typed_subj(t).withColumnRenamed("numInstances", "n")
    return class_prop_occurrence(t).join(all_, "class").filter("numInstances = n").select("class", "property")


def triples_edge_class(t: DataFrame) -> DataFrame:
    """(class, property, numUses): uses by the subject's class, null for untyped subjects; the type itself is left out."""
    uses = t.filter(F.col("p") != TYPE).groupBy(F.col("s").alias("i"), F.col("p").alias("property")).agg(_n().alias("n"))
    joined = uses.join(types(t), "i", "left")
    return joined.groupBy("class", "property").agg(F.sum("n").alias("numUses")).orderBy("numUses", "class", "property")


def tensor_histo(t: DataFrame) -> DataFrame:
    """(type1, p, type2, count): distinct links between typed nodes."""
    ends = types(t).distinct()
    links = t.select("s", "p", "o").distinct()
    first = links.join(ends.select(F.col("i").alias("s"), F.col("class").alias("type1")), "s")
    both = first.join(ends.select(F.col("i").alias("o"), F.col("class").alias("type2")), "o")
    return both.groupBy("type1", "p", "type2").agg(_n().alias("count"))


def blank_subjects(t: DataFrame) -> DataFrame:
    return t.filter(is_blank(F.col("s"))).agg(F.countDistinct("s").alias("numBlanks"))


def isolated_blanks(t: DataFrame) -> DataFrame:
    """Blank subjects that no triple points at and that no inverse functional property identifies."""
    blanks = t.filter(is_blank(F.col("s"))).select(F.col("s").alias("b")).distinct()
    pointed = t.filter(is_blank(F.col("o"))).select(F.col("o").alias("b"))
    keys = types(t).filter(F.col("class") == f"{OWL}InverseFunctionalProperty").select(F.col("i").alias("p"))
    identified = t.filter(is_blank(F.col("s"))).join(keys, "p", "left_semi").select(F.col("s").alias("b"))
    return blanks.join(pointed, "b", "left_anti").join(identified, "b", "left_anti").agg(_n().alias("numIsolatedBlanks"))


def num_typed_subj(t: DataFrame) -> DataFrame:
    """(numTypedSubjects, numSubjects), of subjects with a triple other than their type."""
    subjects = t.filter(F.col("p") != TYPE).select(F.col("s").alias("i")).distinct()
    typed = types(t).filter(F.col("class") != RESOURCE).select("i", F.lit(1).alias("typed")).distinct()
    return subjects.join(typed, "i", "left").agg(F.count("typed").alias("numTypedSubjects"), _n().alias("numSubjects"))


def ontology_ratio(t: DataFrame) -> DataFrame:
    """Distinct classes, concepts, properties and typed resources, in one pass over the types."""
    c = F.col("class")
    of = lambda condition: F.countDistinct(F.when(condition, F.col("i")))
    return types(t).agg(
        of(c.isin(f"{RDFS}Class", f"{OWL}Class")).alias("numDefClasses"),
        of(c == f"{SKOS}Concept").alias("numDefConcepts"),
        of(c == f"{RDF}Property").alias("numDefProperties"),
        of(c != RESOURCE).alias("numTypedResources"),
    )


def explicit_class_hierarchy(t: DataFrame) -> DataFrame:
    sub = t.filter((F.col("p") == f"{RDFS}subClassOf") & (F.col("s") != F.col("o")) & (F.col("o") != RESOURCE))
    return sub.select(F.col("s").alias("subclass"), F.col("o").alias("superclass"))


def explicit_prop_hierarchy(t: DataFrame) -> DataFrame:
    sub = t.filter((F.col("p") == f"{RDFS}subPropertyOf") & (F.col("s") != F.col("o")))
    return sub.select(F.col("s").alias("subprop"), F.col("o").alias("superprop"))


def _contained(members: DataFrame) -> DataFrame:
    """(a, b): sets of ``members`` (set, m...) of which the first is within the second, other one.

    Whatever holds a set holds its rarest member too: only the sets of that one member are candidates, and each is
    checked by counting the members that both have. A set whose rarest member is in no other set is within none.
    """
    keys = [c for c in members.columns if c != "set"]
    members = cut(members.distinct())
    degree = members.groupBy(*keys).agg(_n().alias("k"))
    rarest = members.join(degree, keys).groupBy("set").agg(F.min(F.struct("k", *keys)).alias("m"), _n().alias("n")).filter("m.k > 1")
    owners = members.withColumnRenamed("set", "b")
    candidates = rarest.select(F.col("set").alias("a"), "n", *[F.col(f"m.{c}").alias(c) for c in keys]).join(owners, keys).filter("a <> b").select("a", "b", "n")
    shared = members.withColumnRenamed("set", "a").join(cut(candidates), "a").join(owners, [*keys, "b"]).groupBy("a", "b", "n").agg(_n().alias("shared"))
    return shared.filter("shared = n").select("a", "b")


def implicit_class_hierarchy(t: DataFrame) -> DataFrame:
    """(subClass, superClass): classes all of whose instances another class has too."""
    found = _contained(types(t).select(F.col("class").alias("set"), "i")).filter(F.col("b") != RESOURCE)
    return found.select(F.col("a").alias("subClass"), F.col("b").alias("superClass"))


def implicit_prop_hierarchy(t: DataFrame) -> DataFrame:
    """(subProp, superProp): properties all of whose links another property has too."""
    found = _contained(t.select(F.col("p").alias("set"), "s", "o"))
    return found.select(F.col("a").alias("subProp"), F.col("b").alias("superProp"))


def namespace_links(t: DataFrame, mode: str = "intended") -> DataFrame:
    """(NS1, prop, NS2, numLinks): links between IRIs by their namespaces; ``faithful`` takes whole IRIs for namespaces."""
    links = t.filter(is_iri(F.col("s")) & is_iri(F.col("o")))
    return links.groupBy(namespace(F.col("s"), mode).alias("NS1"), F.col("p").alias("prop"), namespace(F.col("o"), mode).alias("NS2")).agg(_n().alias("numLinks"))


def same_as(t: DataFrame) -> DataFrame:
    return t.filter(F.col("p") == f"{OWL}sameAs").agg(_n().alias("numSameAs"))


def count_pred_voc(t: DataFrame) -> DataFrame:
    """(numVocabularies): distinct namespaces of predicates."""
    return t.select("p").distinct().agg(F.countDistinct(namespace(F.col("p"))).alias("numVocabularies"))


#: Every metric by the name of its query.
METRICS = {
    "NumTriples": num_triples, "DistinctEdges": distinct_edges, "TriplesPerEdge": triples_per_edge,
    "EdgeOccurrence": edge_occurrence, "DistinctPropPerObject": distinct_prop_per_object,
    "PropertiesPerSubject": properties_per_subject, "PropertiesPerObject": properties_per_object, "TypedSubj": typed_subj,
    "ClassTriples": class_triples, "ClassSubjects": class_triples, "ClassPropOccurrence": class_prop_occurrence,
    "CommonClassProp": common_class_prop, "TriplesEdgeClass": triples_edge_class, "TensorHisto": tensor_histo,
    "BlankSubjects": blank_subjects, "IsolatedBlanks": isolated_blanks, "NumTypedSubj": num_typed_subj,
    "OntologyRatio": ontology_ratio, "ExplicitClassHierarchy": explicit_class_hierarchy,
    "ExplicitPropHierarchy": explicit_prop_hierarchy, "ImplicitClassHierarchy": implicit_class_hierarchy,
    "ImplicitPropHierarchy": implicit_prop_hierarchy, "NamspaceLinks": namespace_links, "SameAs": same_as,
}

#: The interactive names of the metrics.
ALIASES = {
    "countTriples": num_triples, "disinctEdges": distinct_edges, "histoPropertyCount": triples_per_edge,
    "histoDistinctSubjectProperty": edge_occurrence, "histoDistinctPropertyCount": edge_occurrence,
    "histoDistinctObjectProperty": distinct_prop_per_object, "histoDistinctPropertySubject": properties_per_subject,
    "histoDistinctPropertyObject": properties_per_object, "histoClassCount": typed_subj, "commonTriplesSubject": class_triples,
    "countTripleSubjClass": class_triples, "histoClassProperty": class_prop_occurrence, "commonHetero": common_class_prop,
    "histoSubjProperty": triples_edge_class, "countBlank": blank_subjects, "countIsoBlanks": isolated_blanks,
    "countTypedSubjects": num_typed_subj, "countOntologyRatio": ontology_ratio, "commonExplicitClass": explicit_class_hierarchy,
    "commonExplicitProperty": explicit_prop_hierarchy, "commonImplicitClass": implicit_class_hierarchy,
    "commonImplicitProperty": implicit_prop_hierarchy, "commonNamespaceLinks": namespace_links, "countOwlSameAs": same_as,
    "countPredVoc": count_pred_voc, "degreeAll": degree_all, "degreeIn": degree_in, "degreeOut": degree_out,
    "degreeMax": degree_max, "degreeNodeType": degree_node_type,
}
